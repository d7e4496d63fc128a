"""How far a match can reach from a seam, told by the patterns of the rules.

A match that crosses a seam is a beginning on one side and an ending on the other.  Every
pattern bounds how many runs of blanks a match can hold: none for tokens, two or three for
``"field": "value"`` and headers.  So a beginning lies within as many blank-free pieces at
the end of a text, an ending within as many at the start of one, however long the pieces
are.  Where blanks are unbounded, a match is a run of the pattern's own characters.
A pattern that is neither reaches through the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesieve.catalog.rules import Rule
from lodesieve.functions.regex import SPACE
from lodesieve.functions.text import bind

MANY = 1 << 30  # no upper limit
_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d+)(,?)(\d*)\})[?+]?")
_ESCAPE = re.compile(r"\\(?:[xpP]\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)", re.DOTALL)
_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL)
_EMPTY = re.compile(r"\\[bBAzZG]|[\^$|]")
_BLANKS = " \t\n\r\x0b\x0c\u00a0\u2003\u3000\ufeff"
_INK = "".join(map(chr, range(33, 127))) + "\u00e9\u4e2d"


def _closing(pattern: str, start: int) -> int:
    """The position behind the group that opens at ``start``."""
    depth, i = 0, start
    while i < len(pattern):
        if pattern[i] == "\\":
            i = _ESCAPE.match(pattern, i).end()
            continue
        if pattern[i] == "[":
            i = _CLASS.match(pattern, i).end()
            continue
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        i += 1
        if depth == 0:
            return i
    raise ValueError(f"unbalanced pattern: {pattern}")


def _most(pattern: str, i: int) -> tuple[int, int]:
    """The upper limit of the quantifier at ``i`` and the position behind it."""
    found = _QUANTIFIER.match(pattern, i)
    if found is None:
        return 1, i
    sign, low, comma, high = found.groups()
    limit = {"?": 1, "*": MANY, "+": MANY}[sign] if sign else int(high or low) if high or not comma else MANY
    return limit, found.end()


def atoms(pattern: str, times: int = 1) -> Iterator[tuple[str, int, int]]:
    """``(atom, limit, times)``: what matches one character, how often in a row, and how often its group repeats."""
    i = 0
    while i < len(pattern):
        if (empty := _EMPTY.match(pattern, i)) is not None:
            i = empty.end()
            continue
        if pattern[i] == "(":
            end = _closing(pattern, i)
            limit, after = _most(pattern, end)
            opening = re.match(r"\((\?:|\?>|\?<?[=!]|\?\w+\)|\?<\w+>)?", pattern[i:])
            if not re.match(r"\?<?[=!]|\?\w+\)", opening[1] or ""):
                yield from atoms(pattern[i + opening.end():end - 1], min(MANY, times * limit))
            i = after
            continue
        found = (_ESCAPE if pattern[i] == "\\" else _CLASS if pattern[i] == "[" else re.compile(r".", re.DOTALL)).match(pattern, i)
        limit, i = _most(pattern, found.end())
        yield found[0], limit, times


@lru_cache(maxsize=None)
def _matches(atom: str) -> tuple[bool, bool]:
    """May the atom match a blank, and anything else?"""
    plain = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), atom).replace(r"\s", r"\s\ufeff" if atom[0] == "[" else r"[\s\ufeff]")
    try:
        one = re.compile(plain, re.DOTALL)
    except re.error:
        return True, True  # a class of another dialect: anything
    return any(one.fullmatch(c) for c in _BLANKS), any(one.fullmatch(c) for c in _INK)


def blank_runs(pattern: str) -> int:
    """The most runs of blanks that a match can hold; MANY if there is no limit."""
    total = 0
    for atom, limit, times in atoms(pattern):
        blank, ink = _matches(atom)
        if blank:
            total += min(MANY, times * (limit if ink else 1))
    return min(MANY, total)


def own_characters(pattern: str) -> str | None:
    """A character class of all that a match can hold; None if the pattern has open atoms."""
    parts = []
    for atom, _, _ in atoms(pattern):
        if atom in (".",) or atom.startswith("[^") or re.fullmatch(r"\\[A-Zp]\S*", atom):
            return None
        # A class inside a class is a union, so ranges stay what they are.
        parts.append(atom.replace(r"\s", SPACE) if atom[0] == "[" else SPACE if atom == r"\s" else atom if len(atom) > 1 else re.sub(r"(\W)", r"\\\1", atom))
    return "[" + "".join(dict.fromkeys(parts)) + "]"


@lru_cache(maxsize=None)
def reach_regexes(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Expressions for what a match can cover from the start of a text; the longest counts."""
    runs = {r.id: 0 if r.token else blank_runs(r.pattern) for r in rules}
    pieces = max((n for n in runs.values() if n < MANY), default=0)
    out = [rf"\A(?:[^{SPACE}]*+[{SPACE}]++){{0,{pieces}}}+[^{SPACE}]*+" if pieces else rf"\A[^{SPACE}]*+"]
    for rule in rules:
        if runs[rule.id] >= MANY:
            own = own_characters(rule.pattern)
            out.append(r"\A[\s\S]*+" if own is None else ("(?i)" if rule.ignore_case else "") + rf"\A{own}*+")
    return tuple(dict.fromkeys(out))


def _reach(text: Column, rules: tuple[Rule, ...]) -> Column:
    lengths = [F.length(F.regexp_extract(text, regex, 0)) for regex in reach_regexes(rules)]
    return F.greatest(*lengths) if len(lengths) > 1 else lengths[0]


def ending_of(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The start of a text, as far as a match of ``rules`` that began before it can reach."""
    return bind(text, lambda t: F.left(t, _reach(t, rules)))


def beginning_of(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The end of a text, as far back as a match of ``rules`` that goes on behind it can begin."""
    return bind(F.reverse(text), lambda t: F.reverse(F.left(t, _reach(t, rules))))
