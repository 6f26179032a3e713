"""Session defaults used by the bench and the tests; a cluster session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "lexloom") -> SparkSession:
    n = str(cores)
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables in one file still give a task per core.
        .config("spark.sql.files.maxPartitionBytes", "4m")
        # Generated methods over 8000 bytes are never compiled by the JVM; wide projections then run interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
