"""Text normalisation, hashing and token columns. Native expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.common import as_col, tags

# Byte sequences that show wrongly decoded UTF-8.
MOJIBAKE_MARKERS = ["Ã", "Â", "Ä", "Å", "áº", "á»", "ðŸ", "�"]


def _accent_pairs() -> tuple[str, str]:
    """Lower-case accented Latin letters and their base letters, from Unicode data."""
    src, dst = [], []
    for lo, hi in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for cp in range(lo, hi):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
            if ch == ch.lower() and base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    return "".join(src) + "đ", "".join(dst) + "d"


_ACCENTED, _PLAIN = _accent_pairs()


def squeeze(c: Column | str) -> Column:
    """Collapse every run of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(as_col(c), r"[\s\x{00a0}]+", " "))


def clean_text(c: Column | str) -> Column:
    """Normalise newlines, squeeze spaces inside each line, keep the lines, trim the whole."""
    t = F.regexp_replace(as_col(c), "\r\n?", "\n")
    t = F.regexp_replace(t, r"[^\S\n]+|\x{00a0}+", " ")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def fold_text(c: Column | str) -> Column:
    """Lower case without accents, spaces squeezed."""
    lowered = F.translate(F.lower(as_col(c)), _ACCENTED, _PLAIN)
    return squeeze(F.regexp_replace(lowered, r"\p{Mn}+", ""))


def slug(c: Column | str) -> Column:
    """snake_case key of a phrase; `unknown` when nothing is left."""
    s = F.regexp_replace(fold_text(F.coalesce(as_col(c), F.lit(""))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(s, F.lit("_")), F.lit("")), F.lit("unknown"))


def mojibake_flags(c: Column | str) -> Column:
    """struct(is_mojibake, reasons, question_mark_count)."""
    s = F.coalesce(as_col(c), F.lit(""))
    marks = F.regexp_count(s, F.lit(r"\?"))
    letters = F.regexp_count(s, F.lit("[A-Za-z]"))
    reasons = tags(
        (s.rlike("|".join(MOJIBAKE_MARKERS)), "mojibake_marker_sequence_detected"),
        (s.rlike(r"[A-Za-z]\?[A-Za-z]"), "replacement_question_mark_in_word"),
        ((marks >= 3) & (letters > 0) & (marks / letters > 0.05), "suspicious_question_mark_density"),
    )
    return F.struct((F.size(reasons) > 0).alias("is_mojibake"), reasons.alias("reasons"),
                    marks.alias("question_mark_count"))


def stable_hash(c: Column | str, n: int = 16) -> Column:
    """First n hex digits of sha256."""
    return F.substring(F.sha2(as_col(c), 256), 1, n)


def tokens(c: Column | str, fold: bool = False) -> Column:
    """Lower-cased ASCII word tokens longer than one character, in order, with repeats."""
    base = fold_text(c) if fold else F.lower(as_col(c))
    return F.regexp_extract_all(base, F.lit("[a-z0-9_]{2,}"), 0)


def word_set(c: Column | str) -> Column:
    words = F.split(F.replace(fold_text(F.coalesce(as_col(c), F.lit(""))), F.lit("_"), F.lit(" ")), " +")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the folded word sets, 0 when either is empty."""
    x, y = word_set(a), word_set(b)
    inter, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(inter / union)
