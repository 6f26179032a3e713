"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans are the leftmost non-overlapping matches of four forms and are always reported. Generators propose many
more spans, which may overlap. The trees learn on a bounded sample (`sample_spans` per family and label, smallest hash
of document, start and end first) which proposals look and stand like base spans of their family. A third of all
proposals is held out from that; over the whole of it, counted by family, label and score, the scores become
probabilities, and per family the least probability is chosen whose precision there is `precision`. So the mix of labels
is the corpus's own at any size. Proposals above it that overlap no base span are added, the best of overlapping ones first.

Null and empty texts have no spans. Repeated rows give a row each. Without proposals of both labels nothing is added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.boost import Trees, fit_trees, monotone_probability
from lexloom.llm.spans import Span, apart, digest, joined
from lexloom.llm.util import arrow_schema, stage

KINDS = ("email", "ip", "card", "phone")

# An address is found from its @: the domain forwards, the name backwards to the end of the match before.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in NAME_CHARS:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                last = m.end()
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Generators: family and pattern. They may overlap each other and the base spans.
GENERATORS = [
    ("email", re.compile(r"[^\s@<>()\[\],;:]{1,64}@[^\s@<>()\[\],;:]{2,255}")),
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[(\[]at[)\]]\s?[A-Za-z0-9-]{1,64}(?:\s?(?:\.|[(\[]dot[)\]])\s?[A-Za-z0-9-]{1,64})+", re.I)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,7}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20./-]?[0-9]{2,7}){2,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\+?[(]?[0-9]{1,4}[)]?(?:[\x20./-]{0,2}[(]?[0-9]{2,5}[)]?){2,5}(?![0-9])")),
]
FAMILIES = ("email", "ip", "card", "phone")
HINTS = {
    "email": re.compile(r"(?i)mail|contact|write|send|cc|from|to:"), "ip": re.compile(r"(?i)\bip\b|host|addr|server|client|login"),
    "card": re.compile(r"(?i)card|visa|pay|credit|account|iban"), "phone": re.compile(r"(?i)tel|phone|call|fax|mobile|whatsapp|\+"),
}
NEAR = 24


def proposals(text: str) -> list[Span]:
    digits = DIGIT.search(text) is not None
    out = set()
    for family, pattern in GENERATORS:
        if digits if family != "email" else ("@" in text or "at]" in text or "at)" in text):
            out |= {(family, m.start(), m.end()) for m in pattern.finditer(text)}
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def span_features(text: str, family: str, a: int, b: int) -> list[float]:
    """Format of the span, and what stands around it; nothing from the check that makes a base span."""
    s, before, after = text[a:b], text[max(0, a - NEAR):a], text[b:b + NEAR]
    groups = re.findall(r"[0-9]+", s)
    kind = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0
    n = len(s)
    return [
        float(FAMILIES.index(family)), n, sum(map(len, groups)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, float(s[0] == "+"), s.count("."), s.count("-"), s.count(" "), s.count("(") + s.count("["), s.count(":"), s.count("/"), s.count("@"),
        sum(c.isalpha() for c in s) / n, sum(c.isupper() for c in s) / n, sum(ord(c) > 127 for c in s) / n, len(set(s)) / n, max((int(g[:6]) for g in groups), default=0) > 255,
        kind(before[-1:]), kind(after[:1]), float(before[-1:] in "#$%.,"), sum(c.isdigit() for c in before) + sum(c.isdigit() for c in after), float(HINTS[family].search(before) is not None),
    ]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document its base spans and proposals with features, out of one pass over the texts."""
    ddl = "doc_id long, base array<struct<kind:string,a:int,b:int>>, found array<struct<family:string,a:int,b:int,y:int,x:array<float>>>"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                spans = base_spans(t)
                base.append([{"kind": k, "a": a, "b": b} for k, a, b in spans])
                known = {(a, b): k for k, a, b in spans}
                found.append([{"family": f, "a": a, "b": b, "y": int(known.get((a, b)) == f), "x": span_features(t, f, a, b)} for f, a, b in proposals(t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, schema.types[1]), pa.array(found, schema.types[2])], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


STEP = 1 / 256  # scores are counted, calibrated and looked up in steps of this log-odds


class Selector:
    """Trees, calibration and the least probability per family (None: nothing is added)."""

    def __init__(self, trees: Trees | None, family: np.ndarray, score: np.ndarray, hits: np.ndarray, n: np.ndarray, precision: float):
        """Of every family and score step: how many held-out proposals there are, and how many of them are base spans."""
        self.trees = trees if n.sum() >= 20 else None
        self.least: dict[str, float] = {}
        if self.trees is None:
            return
        steps, at = np.unique(score, return_inverse=True)
        self.at, self.p = monotone_probability(steps, np.bincount(at, hits), np.bincount(at, n))
        p = self._probability(score)
        for name in FAMILIES:
            own = family == name
            for t in np.unique(p[own]):
                above = own & (p >= t)
                if hits[above].sum() >= precision * n[above].sum():
                    self.least[name] = float(t)
                    break

    def _probability(self, score: np.ndarray) -> np.ndarray:
        return self.p[np.maximum(np.searchsorted(self.at, score, "right") - 1, 0)]

    def choose(self, found: list[dict], base: list[Span]) -> list[Span]:
        if self.trees is None or not found:
            return []
        p = self._probability(score_steps(self.trees, np.array([c["x"] for c in found])))
        out: list[Span] = []
        for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i]["a"], -found[i]["b"], found[i]["family"])):
            c = found[i]
            if p[i] >= self.least.get(c["family"], 2.0) and apart(c["a"], c["b"], base) and apart(c["a"], c["b"], out):
                out.append((c["family"], c["a"], c["b"]))
        return out


def score_steps(trees: Trees, x: np.ndarray) -> np.ndarray:
    return np.floor(trees.score(x) / STEP).astype(np.int64)


def fit_selector(scanned: DataFrame, sample_spans: int = 8000, precision: float = 0.98) -> Selector:
    """Reads at most `sample_spans` proposals per label and family to the driver, and counts of all that are held out."""
    key = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.col("a").cast("string")).cast("binary"))
    rows = scanned.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.a", "c.b", "c.family", "c.y", "c.x").withColumn("key", key)
    order = Window.partitionBy("family", "y").orderBy(F.xxhash64("doc_id", "a", "b"), "doc_id", "a", "b")
    got = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample_spans).select("key", "y", "x").toArrow()
    x, y, key = np.array(got.column("x").to_pylist(), float), got.column("y").to_numpy().astype(float), got.column("key").to_numpy()
    learn = key % 3 != 1
    if min(y.sum(), len(y) - y.sum()) < 20 or len(set(y[learn])) < 2:
        return Selector(None, *[np.zeros(0)] * 4, precision)
    by = np.lexsort((*x.T, y, key))
    by = by[learn[by]]
    trees = fit_trees(x[by], y[by])
    counts = _held_counts(rows.where(F.col("key") % 3 == 1), trees).toArrow()
    return Selector(trees, *(counts.column(c).to_numpy() for c in ("family", "score", "hits", "n")), precision)


def _held_counts(rows: DataFrame, trees: Trees) -> DataFrame:
    """Per family and score step the number of rows and of base spans among them."""
    ddl = "family string, score long, hits long, n long"
    schema, shared = arrow_schema(ddl), rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = score_steps(shared.value, b.column(2).flatten().to_numpy().astype(float).reshape(b.num_rows, -1))
                own = pa.table({"family": b.column(0), "score": score, "y": b.column(1).cast("int64")}).group_by(["family", "score"]).aggregate([("y", "sum"), ("y", "count")])
                yield pa.RecordBatch.from_arrays([own.column(c).combine_chunks().cast(t) for c, t in zip(("family", "score", "y_sum", "y_count"), schema.types)], schema=schema)

    counted = rows.select("family", "y", "x").mapInArrow(run, ddl)
    return counted.groupBy("family", "score").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_spans: int = 8000, precision: float = 0.98) -> DataFrame:
    """Per document: doc_id, counts of base spans, base_sha256, spans, and n_added."""
    scanned = stage(scan(docs, id_col, text_col), "pii")
    selector = docs.sparkSession.sparkContext.broadcast(fit_selector(scanned, sample_spans, precision))
    schema = arrow_schema(RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for b in batches:
            rows = []
            for doc, base, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans: list[Span] = [(s["kind"], s["a"], s["b"]) for s in base]
                more = selector.value.choose(found, spans)
                rows.append((doc, *(sum(k == kind for k, _, _ in spans) for kind in KINDS), digest(spans), joined(sorted(spans + more, key=lambda s: (order[s[0]], s[1]))), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return scanned.mapInArrow(run, RESULT)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_spans: int = 8000, precision: float = 0.98) -> DataFrame:
    """The same rows and columns; in the text every span is replaced by the name of its kind in angle brackets.

    Overlapping base spans (of different kinds) become one replacement, named after the first.
    """
    selector = docs.sparkSession.sparkContext.broadcast(fit_selector(stage(scan(docs, id_col, text_col).select("doc_id", "found"), "pii"), sample_spans, precision))
    at = docs.columns.index(text_col)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        spans = base_spans(t)
        spans += selector.value.choose([{"family": f, "a": a, "b": b, "x": span_features(t, f, a, b)} for f, a, b in proposals(t)], spans)
        out, end = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
            if a >= end:
                out += [t[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
