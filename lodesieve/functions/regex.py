"""Regular-expression dialect: catalogue patterns to ``java.util.regex``.

The catalogue assumes ASCII ``\\b``/``\\w``/``\\d`` and Unicode ``\\s``.  Java's
``\\b`` is Unicode-aware and its ``\\s`` is ASCII, so both are spelled out.
No expression here repeats a group that can match in more than one way, because
the Java engine recurses on those and a long line would end the executor.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import permutations
from re._parser import parse as _parsed
from string import ascii_letters

from lodesieve.catalog.rules import Rule

WORD = r"\w"
WORD_START = f"(?<!{WORD})"
WORD_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE = r"\s\p{Z}\x{FEFF}"


# Java tests a predefined class by one table look-up, three ranges by three nested calls for every character.
_RANGES = [(f"{a}{b}{c}", r"\p{Alnum}") for a, b, c in permutations(("A-Z", "a-z", "0-9"))]


def by_table(pattern: str) -> str:
    """The same pattern with ``A-Za-z0-9`` and ``A-Za-z0-9_`` of its classes as predefined ASCII classes."""
    for ranges, name in _RANGES:
        pattern = pattern.replace(f"{ranges}_", r"\w").replace(ranges, name)
    return pattern


def to_java(pattern: str, ignore_case: bool = False, exact_edges: bool = False) -> str:
    """Spell ``\\b`` and ``\\s`` of a catalogue pattern out for Java.

    A leading ``\\b`` becomes a look-behind, which is right when the pattern opens
    with a word character; ``exact_edges`` is for patterns that may not.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b":
            opening = not exact_edges and (i == 0 or pattern[i - 1] == "|" or pattern[i - 3:i] == "(?:")
            out.append(WORD_START if opening else WORD_EDGE)
        elif two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return ("(?i)" if ignore_case else "") + by_table("".join(out))


def rule_regex(rule: Rule) -> str:
    """The Java form of a rule's pattern."""
    return to_java(rule.pattern, rule.ignore_case)


def is_literal(anchor: str) -> bool:
    """True when an anchor is plain text, so a substring test is enough."""
    return not re.search(r"[\\\[\](){}|?*+.^$]", anchor)


# Prose: words of few letters, each with one mark at most behind it, parted by blanks.  Letters are listed one by one, since
# Java looks such a class up in a table.  Possessive throughout, so a long line neither backtracks nor recurses.
PROSE_LETTERS = ascii_letters + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
PROSE_MARKS = ".,:;!?|"
PROSE_WORD = 18
PROSE = rf"\A(?:[{PROSE_LETTERS}]{{0,{PROSE_WORD}}}+[{PROSE_MARKS}]?+ )*+[{PROSE_LETTERS}]{{0,{PROSE_WORD}}}+[{PROSE_MARKS}]?+\z"


def _needs_other(parsed) -> bool:
    """Does every match of a parsed expression hold a character that prose has not?"""
    plain = frozenset(map(ord, PROSE_LETTERS + PROSE_MARKS + " "))
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and arg not in plain:
            return True
        if name == "IN" and all(str(o) == "LITERAL" and a not in plain or str(o) == "RANGE" and plain.isdisjoint(range(a[0], a[1] + 1))
                                for o, a in arg):
            return True
        if name in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0 and _needs_other(arg[2]):
            return True
        if name == "SUBPATTERN" and _needs_other(arg[3]) or name == "BRANCH" and all(map(_needs_other, arg[1])):
            return True
    return False


def _heads(parsed, n: int, most: int) -> set[str] | None:
    out = {""}
    for op, arg in parsed:
        if all(len(h) >= n for h in out):
            break
        name = str(op)
        if name == "LITERAL":
            following = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            following = {chr(a) for _, a in arg}
        elif name == "SUBPATTERN":
            following = _heads(arg[3], n, most)
        elif name == "BRANCH":
            branches = [_heads(b, n, most) for b in arg[1]]
            following = None if None in branches else set().union(*branches)
        else:
            return None
        if following is None or len(out) * len(following) > most:
            return None
        out = {h if len(h) >= n else (h + x)[:n] for h in out for x in following}
    return out


def few_heads(pattern: str, n: int, most: int = 16) -> frozenset[str] | None:
    """The first ``n`` characters that matches of ``pattern`` can have; None if there are more than ``most``, or no telling."""
    try:
        heads = _heads(_parsed(pattern), n, most)
    except re.error:
        return None
    return None if heads is None else frozenset(heads)


def never_in_prose(rule: Rule, needles: tuple[str, ...]) -> bool:
    """True if no text of the shape ``PROSE`` can hold a match of ``rule``, one of whose ``needles`` every match holds.

    A token holds no blank, so one that is longer than a word with its mark fits nowhere; other rules
    must need a character that prose has not.
    """
    try:
        parsed, anchor = (_parsed(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p))
                          for p in (rule.pattern, rule.anchor))
    except re.error:
        return False
    if needles and not rule.ignore_case and all(_needs_other(_parsed(re.escape(n))) for n in needles):
        return True
    return rule.token and parsed.getwidth()[0] > PROSE_WORD + 1 or _needs_other(anchor)


TOKEN_SHAPE = r"(?=\p{Alnum}++[_.:/+-]|[\w-]{13})"
# Group 1 holds the first two characters of a token; the word goes on behind them, so no start of another is passed over.
TOKEN_OPENING = rf"{WORD_START}{TOKEN_SHAPE}(\p{{Alnum}}{{2}})"


def _by_first_char(anchors: list[str]) -> str:
    groups: dict[str, list[str]] = defaultdict(list)
    rest: list[str] = []
    for anchor in dict.fromkeys(anchors):
        if re.match(r"[A-Za-z](?![?*+{|])", anchor):
            groups[anchor[0]].append(anchor[1:])
        else:
            rest.append(anchor)
    return "|".join([f"{c}(?:{'|'.join(tails)})" for c, tails in sorted(groups.items())] + rest)


def _anywhere(anchors: list[str]) -> str:
    # Anchors that open with a character or a class share one look-ahead on it.
    heads, known, rest = "", [], []
    for anchor in dict.fromkeys(anchors):
        opening = re.match(r"\[((?:[^\\\]]|\\x\{\w+\})+)\]|([A-Za-z0-9\"<-])", anchor)
        if opening:
            heads += (opening[1] or opening[2]) if opening[2] != "-" else r"\-"
            known.append(anchor)
        else:
            rest.append(anchor)
    return "|".join(([f"(?=[{heads}])(?:{'|'.join(known)})"] if known else []) + rest)


@lru_cache(maxsize=None)
def anchor_union(rules: tuple[Rule, ...]) -> str:
    """One expression that matches every text any of ``rules`` can match.

    Anchors at a word start share one look-behind, tokens also one look-ahead,
    and both are grouped by first character, so that most positions of ordinary
    prose are rejected by a single test.
    """
    tokens = [to_java(r.anchor) for r in rules if r.word_start and r.token]
    words = [to_java(r.anchor) for r in rules if r.word_start and not r.token]
    anywhere = [to_java(r.anchor) for r in rules if not r.word_start]
    starts = []
    if tokens:
        starts.append(f"{TOKEN_SHAPE}(?:{_by_first_char(tokens)})")
    if words:
        starts.append(_by_first_char(words))
    parts = [f"{WORD_START}(?:{'|'.join(starts)})"] if starts else []
    return "|".join(parts + ([_anywhere(anywhere)] if anywhere else []))
