"""Ranked retrieval without writing out all pairs: a block-max index and evaluation of whole blocks.

The index holds, per block of items and term, the postings and the largest impact that the term has in the block. What a
query can score in a block is bounded by the sum of its term weights times those impacts. The best blocks of a query are
evaluated first; their k-th score is a threshold that most other blocks cannot reach, and these are never opened. A block
is evaluated in one task, for a chunk of queries at a time, and gives at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import cut_lineage, head_of, text_or_empty, top_k
from lexloom.functions.scan import contained
from lexloom.functions.text import fold_text, tokens

K1, B = 1.5, 0.75  # fixed values of the ranking formula
BLOCK_ITEMS = 256
QUERY_CHUNK = 1024
SALTS = 16
ALL = ""  # the row of a block that lists all of its items; no token is empty


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def blockmax_index(items: DataFrame, fold: bool = False, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(block, term, items, tf, dl, impacts, top) of items(item_id, text), without a shuffle.

    Blocks are runs of at most `block_items` rows of a partition. The row with an empty term lists all items of a block.
    """
    ddl = f"block long, term string, items array<{_kind(items, 'item_id')}>, tf array<int>, dl array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            for a in range(0, b.num_rows, block_items):
                held.append(b.slice(a, block_items))
                if sum(x.num_rows for x in held) >= block_items:
                    t = pa.Table.from_batches(held)
                    yield _block_rows(number, t.slice(0, block_items))
                    number, held = number + 1, t.slice(block_items).to_batches()
        if held and sum(x.num_rows for x in held):
            yield _block_rows(number, pa.Table.from_batches(held))

    rows = cut_lineage(items.select("item_id", tokens("text", fold).alias("toks")).mapInArrow(run, ddl), "index")
    n, avgdl = index_size(rows)
    impact = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1.0 - B + B * dl / max(avgdl, 1e-6)))
    return rows.withColumn("impacts", F.zip_with("tf", "dl", impact)).withColumn("top", F.array_max("impacts"))


def _block_rows(number: int, t: pa.Table) -> pa.RecordBatch:
    ids, toks = t.column("item_id").combine_chunks(), t.column("toks").combine_chunks()
    lengths = np.diff(toks.offsets.to_numpy())
    words = toks.flatten().dictionary_encode()
    key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * t.num_rows + np.repeat(np.arange(t.num_rows), lengths), return_counts=True)
    code, item = key // t.num_rows, key % t.num_rows
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = pa.array(np.concatenate([[0], np.append(starts, len(code)) + t.num_rows]).astype(np.int32))
    item = np.concatenate([np.arange(t.num_rows), item])
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    dl = pa.array(lengths[item].astype(np.int32), mask=toks.is_null().to_numpy(zero_copy_only=False)[item])
    terms = pa.concat_arrays([pa.array([ALL]), words.dictionary.take(pa.array(code[starts])).cast(pa.string())])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(terms), number)), terms, lists(ids.take(pa.array(item))), lists(pa.array(np.concatenate([np.ones(t.num_rows, np.int64), tf]).astype(np.int32))), lists(dl)],
        names=["block", "term", "items", "tf", "dl"])


def index_size(index: DataFrame) -> tuple[int, float]:
    """Number of items and their mean length; items without a text have none."""
    known = F.array_compact("dl")
    whole = index.where(F.col("term") == ALL).select(F.size("items").alias("n"), F.size(known).alias("known"), F.aggregate(known, F.lit(0).cast("long"), lambda s, x: s + x).alias("dl"))
    n, known, total = whole.agg(F.sum("n"), F.sum("known"), F.sum("dl")).first()
    return n or 0, (total or 0) / max(known or 0, 1)


def term_weights(queries: DataFrame, index: DataFrame, keys: list[str], fold: bool = False) -> DataFrame:
    """(keys, term, w): times in the query x inverse frequency, of the terms that the index knows."""
    n, _ = index_size(index)
    qt = queries.select(*keys, F.explode(tokens("text", fold)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf"))
    df = index.join(qt.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("items")).alias("df"))
    return qt.join(df, "term").select(*keys, "term", (F.col("qtf") * F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))


def block_bounds(weights: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, block, bound): no item of the block scores more. A frequent term has a row per block, dealt over SALTS tasks."""
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tops = index.where(F.col("term") != ALL).select("block", "term", "top", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    return tops.join(salted, ["term", "salt"]).groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))


def _chunks(queries: DataFrame) -> int:
    return max(1, -(-queries.select("query_id").distinct().count() // QUERY_CHUNK))


def evaluate_blocks(pairs: DataFrame, weights: DataFrame, index: DataFrame, k: int, digits: int, chunks: int = 1) -> DataFrame:
    """Best k items (query_id, item_id, score) of every (query_id, block), ranked by the rounded score, then by item."""
    asked = pairs.join(weights, "query_id").select("block", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"), "query_id", "term", "w")
    wanted = asked.select("block", "chunk", "term").distinct()
    postings = index.select("block", "term", "items", "impacts").join(wanted, ["block", "term"]).select(F.col("block").alias("in_block"), F.col("chunk").alias("in_chunk"), "term", "items", "impacts")
    ddl = f"query_id {_kind(weights, 'query_id')}, item_id {index.schema['items'].dataType.elementType.simpleString()}, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, impact, place = _columns(right)
        out = []
        for query, own in _by_query(left):
            scores = _scores(own, place, at, impact, len(ids))
            hit = np.flatnonzero(scores > 0)
            best = hit[np.lexsort((ids[hit], -np.round(scores[hit], digits)))[:k]]
            out.append((np.full(len(best), query), ids[best], scores[best]))
        q, i, s = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(q, left.schema.field("query_id").type), "item_id": pa.array(i, right.schema.field("items").type.value_type), "score": pa.array(s, pa.float64())})

    return asked.groupBy("block", "chunk").cogroup(postings.groupBy("in_block", "in_chunk")).applyInArrow(run, ddl)


def _columns(postings: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], dict[str, int]]:
    """Sorted item ids of a block; per term the places of its items and their impacts; where a term stands."""
    items, impacts = postings.column("items").combine_chunks(), postings.column("impacts").combine_chunks()
    ids, place = np.unique(items.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    cuts = np.cumsum(np.diff(items.offsets.to_numpy()))[:-1] if len(items) else []
    at, impact = np.split(place, cuts), np.split(impacts.flatten().to_numpy(), cuts)
    return ids, at, impact, {t: i for i, t in enumerate(postings.column("term").to_pylist())}


def _by_query(weights: pa.Table) -> Iterator[tuple[object, list[tuple[str, float]]]]:
    rows: dict[object, list[tuple[str, float]]] = {}
    for q, term, w in zip(*(weights.column(c).to_pylist() for c in ("query_id", "term", "w"))):
        rows.setdefault(q, []).append((term, w))
    yield from rows.items()


def _scores(own: list[tuple[str, float]], place: dict[str, int], at: list[np.ndarray], impact: list[np.ndarray], n: int) -> np.ndarray:
    found = [(place[t], w) for t, w in own if t in place]
    if not found:
        return np.zeros(n)
    return np.bincount(np.concatenate([at[i] for i, _ in found]), np.concatenate([impact[i] * w for i, w in found]), n)


def blockmax_topk(queries: DataFrame, index: DataFrame, k: int = 5, digits: int = 6, first: int = 2, fold: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): the best k items per query by BM25; those that share no term are not listed.

    `first` blocks of a query are opened for the threshold, then those whose bound reaches it.
    """
    weights = cut_lineage(term_weights(queries, index, ["query_id"], fold), "weights")
    chunks = _chunks(weights)
    bounds = cut_lineage(block_bounds(weights, index), "bounds")
    seeds = cut_lineage(top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], first), "seeds")
    order = [F.desc(F.round("score", digits)), F.asc("item_id")]
    early = cut_lineage(top_k(evaluate_blocks(seeds, weights, index, k, digits, chunks), ["query_id"], order, k, "rank"), "early")
    least = early.where(F.col("rank") == k).select("query_id", (F.col("score") - 10.0 ** -digits).alias("least"))
    rest = open_blocks(bounds.join(seeds.select("query_id", "block"), ["query_id", "block"], "left_anti"), least)
    late = evaluate_blocks(rest, weights, index, k, digits, chunks)
    both = early.select("query_id", "item_id", "score").union(late).withColumn("score", F.round("score", digits))
    return top_k(both, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "rank")


def all_scores(queries: DataFrame, items: DataFrame, keys: list[str], fold: bool = False, block_items: int = 2048) -> DataFrame:
    """(keys, item_id, score) of every item that shares a term with the query; item ids are unique.

    All pairs by definition, but only the postings of asked terms and the term weights are shuffled, once per block and
    chunk of queries; a block's scores are added up in one task and leave it as they are, so no row is written per common term.
    """
    index = blockmax_index(items, fold, block_items)
    weights = cut_lineage(term_weights(queries, index, keys, fold), "weights")
    chunks = max(1, -(-weights.select(*keys).distinct().count() // QUERY_CHUNK))
    dealt = weights.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int"))
    asked = index.where(F.col("term") == ALL).select("block").crossJoin(dealt)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    postings = index.select("block", "term", "items", "impacts").join(weights.select("term").distinct(), "term", "left_semi").select(
        F.col("block").alias("in_block"), numbers.alias("in_chunk"), "term", "items", "impacts")
    ddl = ", ".join([*(f"{k} {_kind(weights, k)}" for k in keys), f"item_id {index.schema['items'].dataType.elementType.simpleString()}", "score double"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, at, impact, place = _columns(right)
        ids = pa.array(ids, right.schema.field("items").type.value_type)
        own: dict[tuple, list[tuple[str, float]]] = {}
        for *key, term, w in zip(*(left.column(c).to_pylist() for c in (*keys, "term", "w"))):
            own.setdefault(tuple(key), []).append((term, w))
        hits, scores = [], []
        for terms in own.values():
            s = _scores(sorted(terms), place, at, impact, len(ids))
            hits.append(np.flatnonzero(s > 0))
            scores.append(s[hits[-1]])
        rows = np.repeat(np.arange(len(own)), [len(h) for h in hits]) if own else np.zeros(0, np.int64)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        named = {k: pa.array([key[j] for key in own], left.schema.field(k).type).take(pa.array(rows)) for j, k in enumerate(keys)}
        return pa.table({**named, "item_id": ids.take(pa.array(flat(hits, np.int64))), "score": pa.array(flat(scores, np.float64))})

    return asked.groupBy("block", "chunk").cogroup(postings.groupBy("in_block", "in_chunk")).applyInArrow(run, ddl)


def open_blocks(bounds: DataFrame, least: DataFrame) -> DataFrame:
    """Those (query_id, block) whose bound reaches the query's threshold; all where it has none."""
    return bounds.join(least, "query_id", "left").where((F.col("bound") * (1 + 1e-9) >= F.col("least")) | F.col("least").isNull()).select("query_id", "block")


class Passages:
    """One block of passages with what queries ask of it: term scores, contained words and phrases, equal keys."""

    def __init__(self, t: pa.Table, avgdl: float, needles: Iterable[str], phrases: Iterable[str]):
        self.ids = t.column("item_id").to_numpy()
        toks = t.column("toks").combine_chunks()
        lengths = np.diff(toks.offsets.to_numpy())
        words = toks.flatten().dictionary_encode()
        key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * t.num_rows + np.repeat(np.arange(t.num_rows), lengths), return_counts=True)
        code, item = key // t.num_rows, key % t.num_rows
        impact = tf * (K1 + 1) / (tf + K1 * (1.0 - B + B * lengths[item] / max(avgdl, 1e-6)))
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        self.at, self.impact = np.split(item, starts[1:]), np.split(impact, starts[1:])
        self.place = {w: i for i, w in enumerate(words.dictionary.take(pa.array(code[starts])).to_pylist())}
        folded = t.column("folded").to_pylist()
        vocabulary: dict[str, list[int]] = {}
        for i, text in enumerate(folded):
            for w in set((text or "").split(" ")):
                vocabulary.setdefault(w, []).append(i)
        inside: dict[str, set[int]] = {}
        for word, found in zip(vocabulary, contained(needles, vocabulary)):
            for needle in found:
                inside.setdefault(needle, set()).update(vocabulary[word])
        self.holds = {needle: np.array(sorted(rows)) for needle, rows in inside.items()}
        self.said = _by_value([list(p) for p in contained(phrases, folded)])
        self.written = _by_value([list(p) for p in contained(phrases, t.column("text").to_pylist())])
        self.keys = {"rule_id": _by_value(t.column("rules").to_pylist()), **{c: _by_value(t.column(c).to_pylist()) for c in ("article", "clause")}}

    def judge(self, q: dict) -> tuple[np.ndarray, np.ndarray]:
        """Lexical and structured score of every passage of the block for one query."""
        n = len(self.ids)
        per = [(v["variant"], np.round(_scores([(w["term"], w["w"]) for w in v["terms"]], self.place, self.at, self.impact, n), 6)) for v in sorted(q["variants"], key=lambda v: v["variant_no"])]
        bm = np.max([s for _, s in per], axis=0) if per else np.zeros(n)
        won = np.argmax([s for _, s in per], axis=0) if per else np.zeros(n, np.int64)
        other = np.array([name != "primary" for name, _ in per] or [False])[won] & (bm > 0)

        def at(rows: np.ndarray | None) -> np.ndarray:
            out = np.zeros(n, bool)
            if rows is not None:
                out[rows] = True
            return out

        ref, conclusion = q["source_ref"] or "", q["conclusion"] or ""
        long_ref = len(ref) > 8
        heads = [at(self.written.get(ref[:size]) if long_ref else None) for size in (40, 24)]
        count = np.zeros(n, np.int64)
        for w in q["words"]:
            if w in self.holds:
                count[self.holds[w]] += 1
        s = 0.1 * other + 6.0 * at(self.keys["rule_id"].get(q["rule_id"])) + np.where(heads[0], 3.5, 2.5 * heads[1])
        s = s + 2.5 * at(self.keys["article"].get(q["article"])) + 1.8 * at(self.keys["clause"].get(q["clause"]))
        return bm, s + 2.2 * at(self.said.get(conclusion) if conclusion else None) + 0.12 * count


def _by_value(values: list) -> dict:
    rows: dict[object, list[int]] = {}
    for i, v in enumerate(values):
        for x in v if isinstance(v, list) else [v]:
            if x is not None:
                rows.setdefault(x, []).append(i)
    return {v: np.array(r) for v, r in rows.items()}


WEIGHTS = (0.42, 0.58)  # fixed values: lexical and structured share


def evidence_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, variants: DataFrame | None = None, index: DataFrame | None = None,
                  question_chars: int | None = None, conclusion_chars: int | None = None, digits: int = 5) -> DataFrame:
    """(query_id, item_id, score, rank): the best k passages per query from lexical and structured signals.

    queries(query_id, text, conclusion, rule_id, article, clause, source_ref), chunks(item_id, text, rule_id or rule_ids,
    article, clause), variants(query_id, variant_no, variant, text) of the queries, the text itself without. Both scores
    are divided by the best of the query. Passages without any signal are not listed.

    Every block is evaluated once for its best values, a row per query and block. These bound what the block can reach;
    only blocks that can still hold one of the best k are evaluated again, for their k best rows.
    """
    index = index if index is not None else blockmax_index(chunks)
    n, avgdl = index_size(index)
    blocks = max(1, -(-n // BLOCK_ITEMS))
    variants = variants if variants is not None else queries.select("query_id", F.lit(0).alias("variant_no"), F.lit("primary").alias("variant"), "text")
    w = term_weights(variants, index, ["query_id", "variant_no", "variant"])
    w = w.groupBy("query_id", "variant_no", "variant").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    w = w.groupBy("query_id").agg(F.collect_list(F.struct("variant_no", "variant", "terms")).alias("variants"))
    words = F.filter(F.split(fold_text(head_of(F.col("text"), question_chars)), " "), lambda x: F.length(x) > 3)
    asked = queries.select("query_id", fold_text(head_of(text_or_empty("conclusion"), conclusion_chars)).alias("conclusion"), "rule_id", "article", "clause", "source_ref", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    asked = cut_lineage(asked.join(w, "query_id", "left").withColumn("variants", F.coalesce("variants", F.array().cast(w.schema["variants"].dataType))), "asked")
    chunk_count = _chunks(asked)
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunk_count)))
    rules = F.col("rule_ids") if "rule_ids" in chunks.columns else F.array("rule_id")
    side = chunks.select("item_id", "text", fold_text("text").alias("folded"), F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("toks"), rules.alias("rules"), "article", "clause",
                         F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("in_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunk_count - 1).cast("long"))).alias("in_chunk"))

    def each(left: pa.Table, right: pa.Table) -> Iterator[tuple[dict, Passages, np.ndarray, np.ndarray]]:
        own = left.to_pylist()
        if own and right.num_rows:
            cut = {q["source_ref"][:size] for q in own if q["source_ref"] for size in (40, 24)} | {q["conclusion"] for q in own}
            block = Passages(right.sort_by("item_id"), avgdl, sorted({x for q in own for x in q["words"]}), sorted(cut))
            for q in own:
                yield q, block, *block.judge(q)

    kinds = _kind(queries, "query_id"), _kind(chunks, "item_id")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for q, _, bm, s in each(left, right):
            one = int(np.argmax(WEIGHTS[0] * bm / (bm.max() or 1e-9) + WEIGHTS[1] * s / (s.max() or 1e-9)))
            rows.append((q["query_id"], q["block"], bm.max(), s.max(), bm[one], s[one]))
        out = list(zip(*rows)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(out, [left.schema.field("query_id").type, pa.int64(), *[pa.float64()] * 4])], names=["query_id", "block", "bm", "s", "one_bm", "one_s"])

    def listed(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for q, block, bm, s in each(left, right):
            score = np.round(WEIGHTS[0] * bm / (q["top_bm"] or 1e-9) + WEIGHTS[1] * s / (q["top_s"] or 1e-9), digits)
            hit = np.flatnonzero((bm > 0) | (s > 0))
            rows += [(q["query_id"], block.ids[i], score[i]) for i in hit[np.lexsort((block.ids[hit], -score[hit]))[:k]]]
        out = list(zip(*rows)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(out, [left.schema.field("query_id").type, right.schema.field("item_id").type, pa.float64()])], names=["query_id", "item_id", "score"])

    every = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    meet = lambda q, f, ddl: q.groupBy("block", "chunk").cogroup(side.groupBy("in_block", "in_chunk")).applyInArrow(f, ddl)
    tops = cut_lineage(meet(every, best, f"query_id {kinds[0]}, block long, bm double, s double, one_bm double, one_s double"), "block_tops")
    whole = tops.groupBy("query_id").agg(F.max("bm").alias("top_bm"), F.max("s").alias("top_s"))
    share = lambda bm, s: WEIGHTS[0] * F.col(bm) / _positive("top_bm") + WEIGHTS[1] * F.col(s) / _positive("top_s")
    seen = tops.join(whole, "query_id").select("query_id", "block", "top_bm", "top_s", share("bm", "s").alias("bound"), share("one_bm", "one_s").alias("one"))
    least = top_k(seen, ["query_id"], [F.desc("one"), F.asc("block")], k, "no").where(F.col("no") == k).select("query_id", (F.col("one") - 2 * 10.0 ** -digits).alias("least"))
    open_ = open_blocks(seen, least).join(whole, "query_id")
    late = meet(asked.join(open_, "query_id"), listed, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    return top_k(late, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "rank")


def _positive(c: str) -> Column:
    return F.when(F.col(c) == 0, F.lit(1e-9)).otherwise(F.col(c))
