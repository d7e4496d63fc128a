"""Rule matching as column expressions.

A scan has two steps, both narrow (no shuffle):

1. ``passes_gate`` tests the union of all rule anchors once per record inside
   whole-stage code generation.  Most records stop here.
2. ``rule_hits`` matches the rest against those rules whose needles occur and
   returns one array of hits per record, which one ``explode`` turns into rows.

Each rule's pattern is a constant of the plan, so it is compiled once per task;
all else about the rules is one constant array.  Patterns that are taken from
that array, for the text around matches, only see records with a match.  Hits carry the 40 characters before the match, so no later step
needs the text.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.catalog.rules import CONTEXT_CHARS, DEFAULT_RULES, NOISY_RULES, Rule
from lodesieve.functions.regex import PROSE, PROSE_LETTERS, PROSE_MARKS, TOKEN_OPENING, anchor_union, few_heads, is_literal, never_in_prose, rule_regex
from lodesieve.functions.text import bind

RECORD_KEYS = ("source", "file", "line", "mtime_ms")

_TABLE_TYPE = ("array<struct<rule_id:string,label:string,confidence:string,ignore_case:boolean,needles:array<string>,"
               "regex:string,gap_regex:string,after_regex:string,width:int>>")


def passes_gate(text: Column, rules: tuple[Rule, ...]) -> Column:
    """True for every text that at least one of ``rules`` could match."""
    return text.rlike(anchor_union(rules))


def is_quiet(text: Column, rules: tuple[Rule, ...]) -> Column:
    """True only for texts that are prose and that none of ``rules`` can match.

    Much cheaper than ``passes_gate``, in front of which it stands: one walk from word to word,
    and plain searches for the few needles that are words.
    """
    loud = [r for r in rules if not never_in_prose(r, needles_of(r))]
    if any(not needles_of(r) for r in loud):
        return F.lit(False)
    spelled = set(PROSE_LETTERS + PROSE_MARKS + " ")  # prose holds no needle with any other character
    return text.rlike(PROSE) & ~has_needle(text, loud, lambda n: spelled.issuperset(n))


def has_needle(text: Column, rules: Iterable[Rule], counts: Callable[[str], bool] = lambda n: True) -> Column:
    """Does ``text`` hold a needle that ``counts`` of any of ``rules``?  It is folded once, and only if a rule asks for it."""
    plain, folded = (sorted({n for r in rules if r.ignore_case == folds for n in needles_of(r) if counts(n)}) for folds in (False, True))
    out = reduce(or_, [F.contains(text, F.lit(n)) for n in plain], F.lit(False))
    if folded:
        out = out | bind(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(n)) for n in folded]))
    return out


def may_match(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Like ``passes_gate``, for a handful of rules: searches for needles, and expressions only for rules without any."""
    unnamed = tuple(r for r in rules if not needles_of(r))
    out = has_needle(text, [r for r in rules if needles_of(r)])
    return out | passes_gate(text, unnamed) if unnamed else out


def gap_regex(rule: Rule) -> str:
    """Expression whose group 1 is the text between the match before and each match.

    ``\\G`` pins every attempt to the end of the match before, so the gaps line up
    with the matches and a text is walked once.
    """
    return rf"\G([\s\S]*?)(?:{rule_regex(rule)})"


def suffix_regex(rule: Rule, width: int) -> str:
    """Expression whose group 1 is the text behind each match of a rule."""
    return rf"(?:{rule_regex(rule)})(?=([\s\S]{{0,{width}}}))"


def rule_table(rules: tuple[Rule, ...], width: int = CONTEXT_CHARS, windows: dict[str, int] | None = None) -> Column:
    """The rules as a constant array column.

    ``width`` is the context kept before a match; rules in ``windows`` also get
    an expression for the text behind it.
    """
    rows = []
    for rule in rules:
        window = (windows or {}).get(rule.id, 0)
        rows.append({
            "rule_id": rule.id, "label": rule.label, "confidence": rule.confidence, "ignore_case": rule.ignore_case,
            "needles": needles_of(rule), "regex": rule_regex(rule), "gap_regex": gap_regex(rule),
            "after_regex": suffix_regex(rule, window) if window else None, "width": max(window, width)})
    return F.from_json(F.lit(json.dumps(rows)), _TABLE_TYPE)


def candidate_rules(text: Column, table: Column) -> Column:
    """The rules of a table that have a needle in ``text`` (or need none), in order."""
    return bind(F.lower(text), lambda low: F.filter(table, lambda r: (F.size(r["needles"]) == 0) | F.exists(
        r["needles"], lambda n: F.contains(F.when(r["ignore_case"], low).otherwise(text), n))))


def needles_of(rule: Rule) -> tuple[str, ...]:
    """Substrings of which every match has one; none if the rule is always tried."""
    if rule.needles is not None:
        return rule.needles
    return (rule.anchor,) if is_literal(rule.anchor) else ()


def opening_of(rule: Rule) -> frozenset[str] | None:
    """The pairs of characters that matches of a token rule open with, None if they are not few."""
    heads = few_heads(rule.anchor, 2) if rule.token and rule.word_start else None
    return heads if heads and all(re.fullmatch("[A-Za-z0-9]{2}", h) for h in heads) else None


def tried_rules(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Ascending positions of the rules that may match ``text``.

    One walk names the openings of all tokens in the text, and a constant map leads
    from an opening to its rules.  Rules with too many openings are tried by needle.
    """
    by_opening: dict[str, list[int]] = defaultdict(list)
    by_needle: list[int] = []
    for i, rule in enumerate(rules):
        openings = opening_of(rule)
        if openings is None:
            by_needle.append(i)
        for opening in sorted(openings or ()):
            by_opening[opening].append(i)

    def needed(i: int, low: Column) -> Column:
        subject = low if rules[i].ignore_case else text
        tests = [F.contains(subject, F.lit(n)) for n in needles_of(rules[i])]
        return F.when(reduce(or_, tests), F.lit(i)) if tests else F.lit(i)

    parts = []
    if by_needle:
        parts.append(bind(F.lower(text), lambda low: F.array_compact(F.array(*[needed(i, low) for i in by_needle]))))
    if by_opening:
        known = F.from_json(F.lit(json.dumps(by_opening)), "map<string,array<int>>")
        openings = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_OPENING), F.lit(1)))
        parts.append(F.flatten(F.array_compact(F.transform(openings, lambda o: F.element_at(known, o)))))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])), F.array().cast("array<int>"))


def matched_rules(text: Column, rules: tuple[Rule, ...], table: Column) -> Column:
    """Array of ``(rule, values)`` for the rules that match ``text``; ``table`` is their ``rule_table``."""
    def values(i: Column, low: int, high: int) -> Column:
        if high - low == 1:
            return F.regexp_extract_all(text, F.lit(rule_regex(rules[low])), F.lit(0))
        middle = (low + high) // 2
        return F.when(i < middle, values(i, low, middle)).otherwise(values(i, middle, high))

    tried = F.transform(tried_rules(text, rules), lambda i: F.struct(
        F.get(table, i).alias("rule"), values(i, 0, len(rules)).alias("values")))
    return F.filter(tried, lambda m: F.size(m["values"]) > 0)


def text_before(values: Column, gaps: Column, i: Column, width: Column) -> Column:
    """The ``width`` characters in front of match ``i``, put together from gaps and earlier matches.

    A match has at least one character, so ``width`` pieces are always enough and
    the work per match is bounded however many matches a text has.
    """
    n = F.least(i, width)
    earlier = F.zip_with(F.slice(gaps, i - n + 1, n), F.slice(values, i - n + 1, n), lambda g, v: F.concat(g, v))
    return F.right(F.concat(F.array_join(earlier, ""), F.get(gaps, i)), width)


def located_matches(text: Column, rules: tuple[Rule, ...], table: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of ``build(rule, value, before)`` over all matches."""
    def per_rule(m: Column) -> Column:
        return bind(F.regexp_extract_all(text, m["rule"]["gap_regex"], F.lit(1)), lambda gaps: F.transform(
            m["values"], lambda v, i: build(m["rule"], v, text_before(m["values"], gaps, i, m["rule"]["width"]))))

    return F.flatten(F.transform(matched_rules(text, rules, table), per_rule))


def hit(rule_id: Column, label: Column, confidence: Column, value: Column, pass_name: str, before: Column | None = None,
        around: Column | None = None, encoding: Column | None = None) -> Column:
    """The struct every pass produces, so that passes can be concatenated."""
    null = F.lit(None).cast("string")
    return F.struct(
        rule_id.alias("rule_id"), label.alias("label"), confidence.alias("confidence"), value.alias("value"),
        (null if before is None else before).alias("before"), (null if around is None else around).alias("around"),
        (null if encoding is None else encoding).alias("encoding"), F.lit(pass_name).alias("pass"))


def rule_hits(text: Column, rules: tuple[Rule, ...], windows: dict[str, int] | None = None, pass_name: str = "raw") -> Column:
    """Array of all hits of ``rules``, in rule order, then match order.

    ``windows`` asks for ``around``, the match with that many characters on both
    sides, for rules whose other half is looked for nearby.
    """
    table = rule_table(rules, windows=windows)

    def details(m: Column) -> Column:
        rule = m["rule"]
        after = F.when(rule["after_regex"].isNotNull(), F.regexp_extract_all(text, rule["after_regex"], F.lit(1)))
        context = F.struct(F.regexp_extract_all(text, rule["gap_regex"], F.lit(1)).alias("gaps"), after.alias("after"))

        def one(c: Column, v: Column, i: Column) -> Column:
            return bind(text_before(m["values"], c["gaps"], i, rule["width"]), lambda b: hit(
                rule["rule_id"], rule["label"], rule["confidence"], v, pass_name,
                before=F.right(b, F.lit(CONTEXT_CHARS)), around=F.concat(b, v, F.get(c["after"], i))))

        return bind(context, lambda c: F.transform(m["values"], lambda v, i: one(c, v, i)))

    return validated(F.flatten(F.transform(matched_rules(text, rules, table), details)), rules)


def holds(rule_id: Column, value: Column, rules: tuple[Rule, ...]) -> Column | None:
    """Does the rule's own check accept the value?  None if no rule has one."""
    checks = [r for r in rules if r.validate is not None]
    if not checks:
        return None
    out = F.lit(True)
    for rule in checks:
        out = F.when(rule_id == rule.id, F.coalesce(rule.validate(value), F.lit(False))).otherwise(out)
    return out


def validated(hits: Column, rules: tuple[Rule, ...]) -> Column:
    """The hits that pass the checks of their rules."""
    if all(r.validate is None for r in rules):
        return hits
    return F.filter(hits, lambda h: holds(h["rule_id"], h["value"], rules))


def extract_matches_sql(spark: SparkSession, name: str = "extract_matches", rules: tuple[Rule, ...] = DEFAULT_RULES) -> None:
    """Register a function for SQL: ``SELECT ... FROM (SELECT extract_matches(text) AS found FROM t), LATERAL explode(found) AS e(m)``.

    It returns an array of ``rule_id, label, confidence, value``, one per match, or NULL.
    The body is one expression of built-in functions, which the optimizer puts into the
    query around it.  Rules with a check of their own need the DataFrame API.
    """
    if any(r.validate is not None for r in rules):
        raise ValueError("rules with a check cannot be a SQL function")

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = json.dumps([{"rule_id": r.id, "label": r.label, "confidence": r.confidence, "ignore_case": r.ignore_case, "needles": needles_of(r),
                        "regex": rule_regex(r)} for r in rules])
    kind = "array<struct<rule_id:string,label:string,confidence:string,ignore_case:boolean,needles:array<string>,regex:string>>"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(input STRING)
        RETURNS ARRAY<STRUCT<rule_id: STRING, label: STRING, confidence: STRING, value: STRING>>
        RETURN CASE WHEN input RLIKE {quoted(anchor_union(rules))} THEN flatten(transform(
            filter(from_json({quoted(rows)}, '{kind}'), r -> size(r.needles) = 0 OR exists(r.needles,
                n -> contains(CASE WHEN r.ignore_case THEN lower(input) ELSE input END, n))),
            r -> transform(regexp_extract_all(input, r.regex, 0), v -> named_struct(
                'rule_id', r.rule_id, 'label', r.label, 'confidence', r.confidence, 'value', v)))) END""")


def explode_hits(records: DataFrame, hits: Column) -> DataFrame:
    """One row per hit, without the text."""
    return records.select(*RECORD_KEYS, F.explode(hits).alias("hit")).select(*RECORD_KEYS, "hit.*")


def scan_rules(records: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, include_noisy: bool = False,
               windows: dict[str, int] | None = None) -> DataFrame:
    """All non-overlapping matches of every rule on every record.

    Rules are independent, so one span may match two of them.  The result still
    holds raw values; see :mod:`lodesieve.plans.scan` for the redacted form.
    """
    if include_noisy:
        rules = rules + NOISY_RULES
    text = F.col("text")
    gated = records.where(passes_gate(text, rules))
    return explode_hits(gated, rule_hits(text, rules, windows))
