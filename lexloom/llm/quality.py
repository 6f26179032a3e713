"""Quality scores by a generalised additive model with pairwise interactions.

Features are read off the whole text. The model is fitted on a bounded sample of labelled rows (`sample_rows`, those
with the smallest hash of their id) that are not held out; all rows are scored by adding up table entries.

Null and empty texts have the features of an empty text and get a score like any other. Repeated rows give a row each.
Without labelled rows, or with labels of one kind only, the score is the smoothed share of that kind (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.boost import Additive, fit_additive, sigmoid
from lexloom.llm.util import arrow_schema, first_by_hash, held_out

_BYTES = np.arange(256)
_CLASSES = np.stack([
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128,
    np.isin(_BYTES, list(b" \t\r\v\f")), _BYTES == 10, np.isin(_BYTES, list(b".,;:'\"-()")), np.isin(_BYTES, list(b"!?")),
    np.isin(_BYTES, list(b"#$%&*@^~_+=\\/")), np.isin(_BYTES, list(b"|<>{}[]`")),
], axis=1).astype(float)
N_FEATURES = len(_CLASSES[0]) + 9


def features(text: bytes | None) -> list[float]:
    """Shares of byte classes; lengths; how much of the words, word pairs and lines is new."""
    text = text or b""
    n = max(1, len(text))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / n
    words, lines = text.split(), text.split(b"\n")
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [*shares, np.log1p(len(text)), np.log1p(len(words)), sizes.mean() if len(words) else 0.0, sizes.std() if len(words) else 0.0,
            float(sizes.max(initial=0)), len(set(words)) / k, len(set(zip(words, words[1:]))) / k, len(set(lines)) / len(lines), np.log1p(n / len(lines))]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 12_000) -> Additive:
    """The model of at most `sample_rows` labels of documents that are not held out; only their features reach the driver."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where(~held_out("id") & F.col("y").isin(0, 1))
    few = F.broadcast(first_by_hash(marks, "id", sample_rows))  # bounded by sample_rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(few, "id")
    got = rows.select("text", "y").mapInArrow(run, "x array<double>, y double").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    by = np.lexsort((*x.T, y))  # the same model whatever order the tasks end in
    x, y = x[by], y[by]
    if len(set(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Additive([], float(np.log(p / (1 - p))), [], [], [], [])
    return fit_additive(x, y)


def _score(model: Additive, texts: pa.Array) -> np.ndarray:
    return sigmoid(model.score(np.array([features(t) for t in texts.cast(pa.binary()).to_pylist()], float).reshape(len(texts), N_FEATURES)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Per document: doc_id, held_out, score (the chance of label 1) and predicted (score >= 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col, **fit))
    schema = arrow_schema("doc_id long, held_out boolean, score double, predicted int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _score(model.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    own = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out(id_col), F.lit(False)), F.col(text_col).cast("string"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **fit) -> DataFrame:
    """The rows whose score is at least `least`, with all their columns."""
    model, at = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, text_col, **fit)), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_score(model.value, b.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)
