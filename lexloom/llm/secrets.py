"""Secret scan: fixed forms, and novelty under a dictionary-primed compressor.

Base spans are the leftmost non-overlapping matches of three forms. Beside them, tokens with digits in a sensitive
context are candidates. A candidate's novelty is the number of bytes that it adds to the compressed surroundings, per
byte, when zstandard is primed with the document's surrounding text and a dictionary of identifiers; what the primed
compressor cannot shorten is reported as `novel`. The identifiers are those around candidates in all documents, most
documents first, `identifiers` of them at most.

Null and empty texts have no spans. Repeated rows give a row each. Very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.spans import Span, apart, digest, joined
from lexloom.llm.util import arrow_schema, stage

KINDS = ("assign", "access", "hex")
NOVEL = "novel"

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")

# Bytes of hex digits to one letter, others to another: finds out quickly that there is no long run.
_HEX_RUN = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))

TOKEN = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
CONTEXT = re.compile(r"(?i)pass|pwd|secret|token|key|auth|bearer|credential|private|signature|sign[_ ]?in|cert|session|cookie|access|salt|api")
REACH = 64  # characters before a candidate in which its context has to stand
AROUND = 1024  # characters of surroundings on each side that prime the compressor


def base_spans(text: str) -> list[Span]:
    out: list[tuple[int, int, int]] = []
    low = text.lower() if any(c in text for c in ":=") else ""
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Long tokens with a digit and a letter, with a word of a sensitive context shortly before."""
    if not any(len(w) >= 16 and any(c in w for c in "0123456789") for w in text.split()):
        return []
    out = []
    for m in TOKEN.finditer(text):
        t = m[0]
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and CONTEXT.search(text, max(0, m.start() - REACH), m.start()):
            out.append((m.start(), m.end()))
    return out


class Novelty:
    """Marginal compressed bytes under a primed dictionary."""

    def __init__(self, identifiers: list[str], level: int = 9):
        self.words, self.level = " ".join(reversed(identifiers)), level  # the end of a dictionary is the cheapest to refer to

    def __call__(self, before: str, candidate: str, after: str) -> float:
        import zstandard

        # At least 8 bytes; the candidate itself is not among its surroundings.
        primer = zstandard.ZstdCompressionDict(f"{self.words}\n{after}\n{before}".encode().rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = lambda s: len(zstandard.ZstdCompressor(level=self.level, dict_data=primer, write_content_size=False).compress(s.encode()))
        lead = before[-REACH:]
        return (size(lead + candidate) - size(lead)) / len(candidate)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document its base spans and its candidates with their surroundings, out of one pass over the texts."""
    ddl = "doc_id long, base array<struct<kind:string,a:int,b:int>>, found array<struct<a:int,b:int,before:string,own:string,after:string>>"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                spans, own = base_spans(t), candidates(t)
                base.append([{"kind": k, "a": a, "b": e} for k, a, e in spans])
                hidden = sorted({(a, e) for a, e in own} | {(a, e) for _, a, e in spans})
                found.append([{"a": a, "b": e, "before": _without(t, max(0, a - AROUND), a, hidden), "own": t[a:e], "after": _without(t, e, e + AROUND, hidden)} for a, e in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, schema.types[1]), pa.array(found, schema.types[2])], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def _without(text: str, a: int, b: int, hidden: list[tuple[int, int]]) -> str:
    """text[a:b] without the hidden spans, so that a secret's second copy does not make the first look known."""
    out, at = [], a
    for s, e in hidden:
        if e > a and s < b:
            out.append(text[at:max(at, s)])
            at = max(at, e)
    return "".join([*out, text[at:b]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: int = 2000, least: float = 0.7) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_novel."""
    scanned = stage(scan(docs, id_col, text_col), "secrets")
    around = scanned.select("doc_id", F.explode("found").alias("c")).select("doc_id", F.explode(F.split(F.concat_ws(" ", "c.before", "c.after"), "[^A-Za-z_]+")).alias("word"))
    counted = around.where(F.length("word") >= 3).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(identifiers).collect()]
    primer = docs.sparkSession.sparkContext.broadcast(words)
    schema = arrow_schema(RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primer.value)
        for b in batches:
            rows = []
            for doc, base, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans: list[Span] = [(s["kind"], s["a"], s["b"]) for s in base]
                more = [(NOVEL, c["a"], c["b"]) for c in found if apart(c["a"], c["b"], spans) and novelty(c["before"], c["own"], c["after"]) >= least]
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                order = {k: i for i, k in enumerate((*KINDS, NOVEL))}
                rows.append((doc, *n, digest(spans), joined(sorted(spans + more, key=lambda s: (s[1], order[s[0]]))), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return scanned.mapInArrow(run, RESULT)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
