import __spark_entry__ as entry
from lexloom.plans import ORACLES, QUERIES


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q) and len(QUERIES) > 150
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    per = {}
    for r in rows:
        per.setdefault(r.query_id, []).append((r.rank, r.score))
    assert rows and all(len(v) <= 5 and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in per.values())
