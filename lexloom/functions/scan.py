"""Pattern matching inside a row: one automaton over the literal heads of all patterns is walked once per text.

A pattern is only tried where one of its heads stands, so a text costs its length and its matches, not its length times
the number of patterns. Matches of one pattern do not overlap; matches of different patterns may. Positions count
characters from 0. Java's classes are meant: `\\s` and `\\d` are ASCII, cases fold by Unicode.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import regex

WORD = r"[\p{L}\p{N}_]"
BLANKS = " \\t\\n\\x0b\\f\\r"
META = set("\\[](){}.*+?|^$")


def compiled(pattern: str) -> regex.Pattern:
    """A pattern of the library in the syntax of the task's engine."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in (r"\s", r"\S", r"\d"):
            out.append({r"\s": BLANKS if inside else f"[{BLANKS}]", r"\S": f"[^{BLANKS}]", r"\d": "0-9" if inside else "[0-9]"}[two])
            i += 2
            continue
        if two[:1] == "\\":
            out.append(two)
            i += 2
            continue
        inside = two[:1] == "[" or inside and two[:1] != "]"
        out.append(two[:1])
        i += 1
    return regex.compile("".join(out), regex.IGNORECASE | regex.UNICODE)


def alternatives(pattern: str) -> list[str]:
    """The branches of a pattern at its top level, one enclosing group aside."""
    depth, start, cuts, square = 0, 0, [], False
    for i, c in enumerate(pattern):
        if i and pattern[i - 1] == "\\" and (i < 2 or pattern[i - 2] != "\\"):
            continue
        if c == "[":
            square = True
        elif c == "]":
            square = False
        elif not square:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                cuts.append(pattern[start:i])
                start = i + 1
    return [*cuts, pattern[start:]]


def heads(pattern: str) -> set[str] | None:
    """Literal beginnings, in lower case, one of which every match has; None where a branch has none."""
    out: set[str] = set()
    for branch in alternatives(pattern):
        if branch.startswith("(?:"):
            depth, end = 0, len(branch)
            for i, c in enumerate(branch):
                depth += (c == "(") - (c == ")")
                if not depth:
                    end = i
                    break
            if branch[end + 1:end + 2] in ("?", "*", "{"):
                return None
            inner = heads(branch[3:end])
            if inner is None:
                return None
            out |= inner
            continue
        n = next((i for i, c in enumerate(branch) if c in META), len(branch))
        if n < len(branch) and branch[n] in "?*{" or n == 0:
            n -= 1
        if n <= 0:
            return None
        out.add(branch[:n].lower())
    return out


class Scanner:
    """Patterns, each a list of alternatives; `whole` asks that a match neither begins nor ends inside a word."""

    def __init__(self, patterns: Sequence[Sequence[str]], whole: bool = True):
        before, after = (f"(?<!{WORD})", f"(?!{WORD})") if whole else ("", "")
        self.rx = [compiled(f"{before}(?:{'|'.join(p)}){after}") for p in patterns]
        self.slow: list[int] = []
        tried: dict[str, list[int]] = {}
        for k, p in enumerate(patterns):
            own = heads("|".join(p))
            if own is None:
                self.slow.append(k)
            else:
                for h in own:
                    tried.setdefault(h, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for h, ks in tried.items():
            self.automaton.add_word(h, (len(h), ks))
        if tried:
            self.automaton.make_automaton()
        self.fast = sorted({k for ks in tried.values() for k in ks})

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(pattern, start, end) of all matches; by pattern in the order of the text."""
        low = text.lower()
        plain = len(low) == len(text)
        for k in self.slow if plain else range(len(self.rx)):
            for m in self.rx[k].finditer(text):
                yield k, m.start(), m.end()
        if plain and len(self.automaton):
            places: dict[int, set[int]] = {}
            for end, (size, ks) in self.automaton.iter(low):
                for k in ks:
                    places.setdefault(k, set()).add(end - size + 1)
            for k, starts in places.items():
                last = 0
                for a in sorted(starts):
                    if a >= last and (m := self.rx[k].match(text, a)):
                        yield k, a, m.end()
                        last = max(m.end(), a + 1)


def contained(patterns: Iterable[str], texts: Iterable[str | None]) -> Iterator[set[str]]:
    """Per text the patterns that stand in it: one automaton over all patterns, walked once per text."""
    automaton = ahocorasick.Automaton()
    for p in patterns:
        if p:
            automaton.add_word(p, p)
    if len(automaton):
        automaton.make_automaton()
    for text in texts:
        yield {p for _, p in automaton.iter(text)} if text and len(automaton) else set()
