"""Spans of interest in whole texts: (kind, start, end), code points, end exclusive."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart(a: int, b: int, spans: list[Span]) -> bool:
    """True if [a, b) overlaps none of the spans."""
    return all(b <= s or e <= a for _, s, e in spans)
