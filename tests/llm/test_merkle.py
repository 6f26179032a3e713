import hashlib
import random
import zlib

from lexloom.llm.merkle import FIELDS, manifest, verified, without_newlines

DDL = "doc_id long, source string, lang string, n_chars long, text string, root string, path string, lo long, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def fold(leaves, at, proof, fan):
    """Root of a list of nodes; appends the siblings of node `at` level by level and gives (root, steps)."""
    while len(leaves) > 1:
        a = at // fan * fan
        run = leaves[a:a + fan]
        proof.append(("".join(run[:at - a]), "".join(run[at - a + 1:])))
        leaves, at = [h(*leaves[i:i + fan]) for i in range(0, len(leaves), fan)], at // fan
    return leaves[0]


def brute(rows, fan=3):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
    subroots = [fold([x[2] for x in trees[s]], 0, [], fan) for s in order]
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(trees[s]):
            path = []
            sub = fold([x[2] for x in trees[s]], i, path, fan)
            root = fold(subroots, k, path, fan)
            acc = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                acc = leaf((*r[:4], r[4] and r[4].replace("\n", "")))
            for left, right in path:
                acc = h(left, acc, right)
            out.append((r[0], own, sub, root, h(*[a + b for a, b in path]), acc, acc == root))
    return sorted(out, key=str)


def run(spark, rows, fan=3):
    docs = spark.createDataFrame([(*r, "x", "y", 0, "z") for r in rows], DDL).repartition(4)
    got = verified(manifest(docs, without_newlines(), fan)).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, got.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for source, k in (("a", 82), ("b", 1), (None, 4), ("", 3), ("é", 9), ("Z", 2), ("z:1", 27)):
        ids = rng.sample(range(10_000), k)
        rows += [(i, source, rng.choice([None, "en", ""]), rng.choice([None, 0, 7]), rng.choice([None, "", "\n", f"é{i}\nx\n", "w " * 5000 + f"\n{i}"])) for i in ids]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, fan=2) == brute(rows, 2)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", None, 1, "t\n")] * 5 + [(1, "a", None, 1, "other")] + [(None, "a", "x", None, "t\n")] * 2 + [(None, None, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    one = run(spark, [(7, "s", "en", 3, "a\nb")])
    assert one == brute([(7, "s", "en", 3, "a\nb")]) and one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")


def test_tampering_is_found(spark):
    rows = [(i, f"s{i % 4}", "en", 1, f"line\n{i}" if i % 3 else f"line {i}") for i in range(40)]
    for r, (_, text) in zip(run(spark, rows), [(r[0], r[4]) for r in sorted(rows, key=lambda r: str((r[0], leaf(r))))]):
        assert r[6] == (not (zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in text))
    assert FIELDS[0] == "doc_id"
