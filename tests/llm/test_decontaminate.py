import hashlib
import random
import re

from lexloom.llm.decontaminate import Shard, decontaminate, keep_clean, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window, share=20):
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for item, text in items:
            q = words(text)
            for a in range(max(1, len(q) - window + 1) if q else 0):
                own = q[a:a + window]
                for p in range(len(w) - len(own) + 1):
                    if w[p:p + len(own)] == own:
                        hit |= set(range(p, p + len(own)))
                        named.add(str(item))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "cé", "Dd", "7", "ſ", "x" * 70]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(9, say(9)), (10, say(3)), (11, None), (12, "..."), (13, say(30)), (2, "cé")]
    items.append((14, items[0][1]))
    docs = [(i, say(rng.randrange(60))) for i in range(40)] + [(90, None), (91, ""), (92, items[4][1].upper() + say(5)), (92, items[4][1]), (93, "zz " * 500)]
    return docs, items


def test_against_brute_force(spark, docs_of):
    docs, items = case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, block in ((5, 1 << 20), (13, 40)):
        got = decontaminate(docs_of(docs), bench, window=window, block_bytes=block, shard_bytes=400)
        want = brute(docs, items, window)
        assert sorted([tuple(r)[:6] for r in got.collect()], key=str) == want
        kept = keep_clean(docs_of(docs), bench, window=window, block_bytes=block, shard_bytes=400)
        assert kept.columns[:2] == ["doc_id", "text"] and sorted([r.doc_id for r in kept.collect()]) == sorted(r[0] for r in want if not r[5])


def test_rows_without_id_are_judged_by_themselves_at_every_benchmark_size(spark, docs_of):
    docs, items = case(3)
    docs = [(i if i % 3 == 1 else None, t) for i, (_, t) in enumerate(docs)] + [(None, items[4][1]), (None, "zz zz"), (None, None), (70, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([d for d, r in zip(docs, (brute([d], items, 5)[0] for d in docs)) if not r[5]], key=str)
    assert 0 < len(want) < len(docs)
    for block in (40, 1 << 20):
        kept = keep_clean(docs_of(docs), bench, window=5, block_bytes=block, shard_bytes=400)
        assert kept.columns == docs_of(docs).columns
        assert sorted([tuple(r)[:2] for r in kept.collect()], key=str) == want


def test_hits_of_a_row_add_up_over_blocks(spark, docs_of):
    items = [(1, "a b c d e"), (2, "f g h i j")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(None, "a b c d e " + "x " * 20), (None, "a b c d e f g h i j " + "x " * 20), (3, "f g h i j"), (4, "x")]
    for block in (1, 1 << 20):
        kept = keep_clean(docs_of(docs), bench, window=5, share=3, block_bytes=block)
        assert sorted(r.text for r in kept.collect()) == sorted([docs[0][1], "x"])


def test_items_without_id_and_clashing_columns(spark):
    bench = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (8, "v w x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e", "q", 1), (2, "none of it", "q", 2), (None, "v w x y z", "q", 3)], "doc_id long, text string, __gone string, spans int")
    for block in (1, 1 << 20):
        got = {r.doc_id: r for r in decontaminate(docs, bench, window=5, block_bytes=block).collect()}
        assert (got[1].n_items, got[2].n_items, got[None].n_items) == (2, 0, 1)
        assert got[1].items_sha256 == hashlib.sha256(b",7").hexdigest() and got[None].items_sha256 == hashlib.sha256(b"8").hexdigest()
        assert [tuple(r) for r in keep_clean(docs, bench, window=5, block_bytes=block).collect()] == [(2, "none of it", "q", 2)]


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs_of([]), bench).count() == 0
    assert [r.n_hit for r in decontaminate(docs_of([(1, "a b")]), bench).collect()] == [0]


def test_suffix_order():
    docs, _ = case(5)
    shard = Shard([(t or "").encode() for _, t in docs] * 3)
    w, order = shard.words.tolist(), suffix_array(shard.words).tolist()
    assert sorted(order) == list(range(len(w)))
    own = [w[i:w.index(0, i) + 1] for i in order]
    assert own == sorted(own)
