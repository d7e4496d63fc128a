"""Prompt-injection markers, a third category and opt-in.  Nothing is suppressed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.catalog.rules import CHATML_RULE, OVERRIDE_PHRASE_RULE, ZERO_WIDTH_RULE
from lodesieve.functions.regex import to_java
from lodesieve.functions.text import bind
from lodesieve.operators.extract import explode_hits, hit, passes_gate, rule_hits


def code_point_name(char: Column) -> Column:
    """``U+200B`` style name of a one-character string."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def summarize_characters(chars: Column) -> Column:
    """``U+200B ×2, U+2060 ×1`` in order of first appearance."""
    def text(all_chars: Column) -> Column:
        return F.array_join(F.transform(F.array_distinct(all_chars), lambda c: F.concat(
            code_point_name(c), F.lit(" ×"), F.size(F.filter(all_chars, lambda x: x == c)).cast("string"))), ", ")

    return bind(chars, text)


def suspicious_invisibles(text: Column) -> Column:
    """Array of invisible characters that ordinary script joining does not explain."""
    return F.regexp_extract_all(text, F.lit(to_java(ZERO_WIDTH_RULE.pattern)), F.lit(0))


def zero_width_hits(text: Column) -> Column:
    """At most one hit per text: a summary of its suspicious invisible characters."""
    rule = ZERO_WIDTH_RULE
    found = F.filter(F.array(suspicious_invisibles(text)), lambda m: F.size(m) > 0)
    return F.transform(found, lambda m: hit(
        F.lit(rule.id), F.lit(rule.label), F.lit(rule.confidence), summarize_characters(m), "injection"))


def injection_hits(text: Column, include_noisy: bool = False) -> Column:
    """Array of all injection markers of a text."""
    parts = [rule_hits(text, (CHATML_RULE,), pass_name="injection"), zero_width_hits(text)]
    if include_noisy:
        parts.append(rule_hits(text, (OVERRIDE_PHRASE_RULE,), pass_name="injection"))
    return F.concat(*parts)


def scan_injection(records: DataFrame, include_noisy: bool = False) -> DataFrame:
    """Control tokens, hidden characters and, when noisy rules are on, override phrases."""
    rules = (CHATML_RULE, ZERO_WIDTH_RULE) + ((OVERRIDE_PHRASE_RULE,) if include_noisy else ())
    gated = records.where(passes_gate(F.col("text"), rules))
    return explode_hits(gated, injection_hits(F.col("text"), include_noisy))
