"""Masking: previews of findings, and whole columns with every secret replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.catalog.rules import DEFAULT_RULES, HIGH_RULES, NOISY_RULES, Rule
from lodesieve.functions.text import (bind, escape_invisibles, has_constant_tail, is_vendor_example, redact,
                                      strip_control_chars, truncate)
from lodesieve.operators.extract import candidate_rules, matched_rules, passes_gate, rule_table


def with_preview(matches: DataFrame) -> DataFrame:
    """Replace the raw ``value`` by its masked ``preview``."""
    return matches.withColumn("preview", redact(F.col("value"))).drop("value")


def _replace_matches(text: Column, regex: Column, spare_examples: bool) -> Column:
    # Texts alternate gap, match, gap, ...; the matches are masked and all is joined again.
    def rebuild(matches: Column) -> Column:
        masked = F.transform(matches, lambda m: F.when(
            is_vendor_example(m) | has_constant_tail(m), m).otherwise(redact(m)) if spare_examples else redact(m))
        pieces = F.zip_with(F.split(text, regex, -1), masked, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        return F.when(F.size(matches) == 0, text).otherwise(F.array_join(pieces, ""))

    return bind(F.regexp_extract_all(text, regex, F.lit(0)), rebuild)


def redacted(text: Column, rules: tuple[Rule, ...] = HIGH_RULES, spare_examples: bool = True) -> Column:
    """``text`` with every match masked, rule by rule in catalogue order.

    Rules are applied one after another to the text the rules before have left,
    as a fold over the rules whose needles occur in it.  Masking a match cannot
    create a new match, because a preview keeps at most eight of its characters
    around an ellipsis.
    """
    folded = F.aggregate(candidate_rules(text, rule_table(rules)), text,
                         lambda acc, r: _replace_matches(acc, r["regex"], spare_examples))
    return F.when(passes_gate(text, rules), folded).otherwise(text)


def first_hit(text: Column, rules: tuple[Rule, ...] = HIGH_RULES, first_match_only: bool = False) -> Column:
    """Struct ``(label, preview)`` of the first unsuppressed hit, in rule order.

    With ``first_match_only`` only the first match of each rule is looked at.
    """
    def live(values: Column) -> Column:
        seen = F.slice(values, 1, 1) if first_match_only else values
        return F.filter(seen, lambda m: ~is_vendor_example(m) & ~has_constant_tail(m))

    hits = F.transform(matched_rules(text, rules, rule_table(rules)), lambda m: F.struct(
        m["rule"]["label"].alias("label"), F.get(live(m["values"]), 0).alias("value")))
    first = bind(F.get(F.filter(hits, lambda h: h["value"].isNotNull()), 0), lambda h: F.when(
        h.isNotNull(), F.struct(h["label"].alias("label"), redact(h["value"]).alias("preview"))))
    return F.when(passes_gate(text, rules), first)


def redact_text(df: DataFrame, cols: list[str], rules: tuple[Rule, ...] = HIGH_RULES) -> DataFrame:
    """Mask secrets inside text columns; NULL stays NULL."""
    for c in cols:
        df = df.withColumn(c, redacted(F.col(c), rules))
    return df


# What a preview shows of a command or name; only what is shown is cut, never what is stored or matched.
PREVIEW_CHARS = 160


def sanitize_note(note: Column, limit: int | None = None) -> Column:
    """A free-text note that is safe to store: control characters out, any rule's match masked, cut only if asked."""
    masked = bind(strip_control_chars(note), lambda t: redacted(t, DEFAULT_RULES + NOISY_RULES, spare_examples=False))
    return masked if limit is None else truncate(masked, limit)


def safe_preview(text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """A command or name that is safe to show: masked, invisible characters spelled out, bounded."""
    masked = bind(strip_control_chars(text), lambda t: redacted(t, DEFAULT_RULES, spare_examples=False))
    return truncate(escape_invisibles(masked), limit)
