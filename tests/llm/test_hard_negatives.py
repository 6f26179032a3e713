import math
import random

import numpy as np
import pytest

from lexloom.llm.hard_negatives import DEPTH, best_of, mine_negatives, primes_for, residues, scores


def brute(rows, ask, positives=5, negatives=3, window=(50, 95, 100), scale=256):
    """Counted over rows one by one, with Python's integers."""
    sound = [(i, lab, [math.floor(float(x) * scale) for x in v]) for i, v, lab in rows
             if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in sound:
        if i % ask:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in sound]
        for p, j, _ in sorted(x for x in scored if x[2] == lab and x[1] != i)[:positives]:
            fits = sorted(x for x in scored if x[2] != lab and window[0] * -p <= window[2] * -x[0] <= window[1] * -p)[:negatives]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(fits)]
    return sorted(out)


def table(spark, rows):
    ddl = "vec_id long, embedding array<float>, label int, seq string, block string, score int, id string"
    return spark.createDataFrame([(*r, "x", "y", 0, "z") for r in rows], ddl).repartition(3)


def test_residues_give_exact_products():
    rng = np.random.default_rng(1)
    for size, top in ((1, 3), (DEPTH, 300), (3 * DEPTH + 5, 300), (7, 10 ** 8)):
        a, b = rng.integers(-top, top + 1, (5, size)), rng.integers(-top, top + 1, (9, size))
        a[0], b[0] = top, -top
        primes = primes_for(top * top * size)
        assert scores(residues(a, primes), residues(b, primes), primes).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()
        assert math.prod(primes) > 2 * top * top * size and max(DEPTH * ((p - 1) // 2) ** 2 for p in primes) <= 1 << 24


def test_ties_go_to_the_smaller_id():
    s, i = best_of(np.array([[5, 7, 7, 5]]), np.array([1, 2, 3, 4]), 3)
    assert s.tolist() == [[7, 7, 5]] and i.tolist() == [[2, 3, 1]]


@pytest.mark.parametrize("blocks", [(4096, 65536), (3, 20)])
def test_against_brute_force(spark, blocks):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        v = [rng.choice([0.0, 0.5, -0.25, 0.3, 1.0, 2.5]) for _ in range(6)]
        rows.append((i, v, rng.choice([0, 0, 1, 2])))
    rows += [(200, None, 1), (210, [None] * 6, 1), (None, [1.0] * 6, 1), (220, [1.0] * 6, None), (230, [float("nan")] + [1.0] * 5, 0), (240, [float("inf")] + [0.0] * 5, 0)]
    rows += [(250, [1.0, 1.0], 1), (260, [], 0), (270, [9000.0, -70.0, 0.001, 3.0, 1.0, 1.0], 1)] + [(300 + k, [1.0, 0.5, 0.5, 0.25, 0.3, 2.5], k % 2) for k in range(30)]
    got = mine_negatives(table(spark, rows), "id % 10 = 0", block_rows=blocks[0], group_rows=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute(rows, 10) != []


def test_repeated_rows_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0], 1)] * 2 + [(3, [1.0, 0.0], 1)] * 2 + [(4, [0.75, 0.0], 2)] * 2 + [(5, [0.5, 0.0], 2), (6, [1.0, 0.0], 2)]
    got = sorted(map(tuple, mine_negatives(table(spark, rows), "id % 10 = 0").collect()))
    assert got == brute(rows, 10) and {r[3] for r in got} == {4, 5}
    assert mine_negatives(table(spark, []), "id % 10 = 0").count() == 0
    assert mine_negatives(table(spark, rows), "id < 0").count() == 0
    assert mine_negatives(table(spark, [(0, [1.0], 1)]), "id = 0").count() == 0
