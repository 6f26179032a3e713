"""Language of mixed text: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score per language is the log-probability of its letters, each with its neighbours, learned from a bounded sample of labelled
rows (`sample_rows`, the same number of texts per language at most; smallest hash of the id first) that are not held
out. Languages never seen in a script get no part of its words. Changing the language from one word to the next costs
`switch`; the best path gives the spans, and the language with most letters in them is the prediction.

Null texts and texts without letters are `und` with score 0, and so is everything when nothing could be learned.
Repeated rows give a row each. A chunk without white space is one word; letters of several scripts in it count each
for the languages of their script.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.util import arrow_schema, held_out

UNKNOWN = "und"
CACHED_WORDS = 250_000
FOREIGN = -20.0  # a letter of a script that the language was never seen in
RARE = 0.001  # share of a language's letters below which a script isn't its own
BITS = 21

# Fixed ranges of scripts: name, first and last code point.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, and the number of its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a:b + 1] = SCRIPT_NAMES.index(name)
    return letter, script


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased text; where letters are; each letter with its neighbours (0: none) as one number."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    own = np.where(letter_tables()[0][code], code, 0)
    at = np.flatnonzero(own)
    return code, at, (own[at - 1] << 2 * BITS) | (own[at] << BITS) | own[at + 1]


class Model:
    """Log-probabilities of letters with their neighbours per language, and the scripts of each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray, scripts: np.ndarray):
        """grams: sorted; counts: (grams, languages); scripts: letters per (script, language)."""
        self.langs, self.grams, least = langs, grams, 0.5
        size = np.log(counts.sum(0) + least * (len(grams) + 1))
        self.table = np.concatenate([np.log(counts + least) - size, [np.log(least) - size]]).astype(np.float32)  # last: unseen
        self.able = scripts > RARE * np.maximum(scripts.sum(0), 1)

    def words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk: scores per language, and the number of letters."""
        code, at, gram = letters_of("\n".join(chunks))
        i = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        score = self.table[np.where(self.grams[i] == gram, i, len(self.grams))]
        able = self.able[letter_tables()[1][code[at]]]
        score = np.where(able, score, np.float32(FOREIGN))
        score[~able.any(1)] = 0  # no learned language uses the script: tells nothing
        chunk = np.searchsorted(np.flatnonzero(code == 10), at)
        cuts = np.searchsorted(chunk, np.arange(len(chunks) + 1))
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(score, axis=0, dtype=np.float64)])
        return (total[cuts[1:]] - total[cuts[:-1]]).astype(np.float32), np.diff(cuts)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> Model:
    """Counts per language over the sample; Spark adds them up before they reach the driver."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        ~held_out("id") & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    # Ids are ranked without their texts, so that only ids are shuffled for it.
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    few = rows.select("id", "lang").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample_rows).select("id", F.col("lang").alias("its"))
    sample = rows.join(F.broadcast(few), "id").where(F.col("lang") == F.col("its"))  # few: sample_rows per language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_pylist()
            for lang in set(langs):
                code, at, gram = letters_of(" ".join(t for t, x in zip(b.column(0).to_pylist(), langs) if x == lang))
                keys, n = np.unique(np.concatenate([gram, -1 - letter_tables()[1][code[at]].astype(np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    got = sample.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = got.column("lang").to_pylist(), got.column("gram").to_numpy(), got.column("n").to_numpy()
    langs = sorted(set(lang))
    which = np.array([langs.index(x) for x in lang], np.int64)
    grams, scripts = np.unique(gram[gram >= 0]), np.zeros((len(SCRIPT_NAMES), len(langs)))
    counts = np.zeros((len(grams), len(langs)))
    counts[np.searchsorted(grams, gram[gram >= 0]), which[gram >= 0]] = n[gram >= 0]
    scripts[-1 - gram[gram < 0], which[gram < 0]] = n[gram < 0]
    return Model(langs, grams, counts, scripts)


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi for many texts at once: scores (texts, words, languages), the languages of the best paths (texts, words)."""
    d, t, _ = scores.shape
    best = scores[:, 0].copy()
    stay, top = np.ones(scores.shape, bool), np.zeros((d, t), np.int16)
    final = best.copy()
    for i in range(1, t):
        live = lengths > i
        top[:, i] = lead = best.argmax(1)
        jump = best[np.arange(d), lead][:, None] - switch
        stay[:, i] = best >= jump
        best = np.maximum(best, jump) + scores[:, i]
        final[live] = best[live]
    path = np.zeros((d, t), np.int16)
    now = np.zeros(d, np.int64)
    rows = np.arange(d)
    for i in range(t - 1, -1, -1):
        last = lengths - 1 == i
        now[last] = final[last].argmax(1)
        path[:, i] = now
        now = np.where(stay[rows, i, now], now, top[:, i])
    return path


class Tagger:
    """Scores words once and labels texts in groups of like length."""

    def __init__(self, model: Model, switch: float, cells: int = 1 << 19):
        self.model, self.switch, self.cells = model, switch, cells
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1 << 12, np.int64)

    def _words(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.row) > CACHED_WORDS:
            self._forget()
        chunks, row = [(t or "").split() for t in texts], self.row
        new = list({c for own in chunks for c in own if c not in row})
        if new:
            n = len(row)
            row.update(zip(new, range(n, n + len(new))))
            if len(row) > len(self.letters):
                more = max(len(row), 2 * len(self.letters)) - len(self.letters)
                self.scores, self.letters = np.pad(self.scores, ((0, more), (0, 0))), np.pad(self.letters, (0, more))
            self.scores[n:len(row)], self.letters[n:len(row)] = self.model.words(new)
        out = []
        for own in chunks:
            at = np.array([row[c] for c in own], np.int64)
            at = at[self.letters[at] > 0]
            out.append((self.scores[at], self.letters[at]))
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """Per text: the language, its share of the letters, and the spans as (language, words)."""
        langs = self.model.langs
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        if not langs or not len(self.model.grams):
            return out
        words = self._words(texts)
        order = sorted((i for i, (s, _) in enumerate(words) if len(s)), key=lambda i: len(words[i][0]))
        while order:
            n = len(words[order[-1]][0])  # the longest left, and as many of about its length as fit
            group = order[-max(1, self.cells // n):]
            group = [i for i in group if 2 * len(words[i][0]) >= n]
            del order[-len(group):]
            lengths = np.array([len(words[i][0]) for i in group])
            scores = np.zeros((len(group), n, len(langs)), np.float32)
            for k, i in enumerate(group):
                scores[k, :lengths[k]] = words[i][0]
            path = best_paths(scores, lengths, self.switch)
            for k, i in enumerate(group):
                own = path[k, :lengths[k]]
                share = np.bincount(own, words[i][1], len(langs))
                cuts = np.flatnonzero(np.diff(own, prepend=-1))
                spans = [(langs[own[a]], int(b - a)) for a, b in zip(cuts, [*cuts[1:], len(own)])]
                out[i] = (langs[int(share.argmax())], float(share.max() / share.sum()), spans)
        return out


def label_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1500,
                    switch: float = 12.0, spans: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; with `spans` also the runs of words per language."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, sample_rows))
    ddl = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<lang:string,words:long>>" if spans else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value, switch)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                got = tagger.label(part.column(2).to_pylist())
                cols = [part.column(0), part.column(1), [g[0] for g in got], [g[1] for g in got]] + ([[[{"lang": a, "words": n} for a, n in g[2]] for g in got]] if spans else [])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    own = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out(id_col), F.lit(False)), F.col(text_col).cast("string"))
    return own.mapInArrow(run, ddl)
