"""Suppression: matches that are certainly, or very likely, not a leak.

A suppressed match is never lost.  It keeps its reason, is counted, and is
reported at low confidence when the caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.catalog.rules import NOISY_RULE_IDS
from lodesieve.functions.text import (bigram_fraction, has_constant_tail, is_placeholder_context, is_random,
                                      is_vendor_example)

# The reasons are part of the result.
VENDOR_EXAMPLE = "vendor-documented example value"
ZERO_ENTROPY = "zero-entropy body"
PLACEHOLDER = "placeholder-like context"
NATURAL_LANGUAGE = "reads like natural language, not random"


def suppression_reason(value: Column, before: Column, rule_id: Column) -> Column:
    """First reason that applies, or NULL.

    ``before`` is NULL for matches found after a transformation of the record
    (decoding, joining), where no text precedes the value.
    """
    noisy = rule_id.isin(*NOISY_RULE_IDS)
    return (F.when(is_vendor_example(value), F.lit(VENDOR_EXAMPLE))
            .when(has_constant_tail(value), F.lit(ZERO_ENTROPY))
            .when(before.isNotNull() & is_placeholder_context(before), F.lit(PLACEHOLDER))
            .when(noisy & ~is_random(value), F.lit(NATURAL_LANGUAGE)))


def suppress_vendor_examples(matches: DataFrame) -> DataFrame:
    """Drop matches whose value is a documented example."""
    return matches.where(~is_vendor_example(F.col("value")))


def suppress_zero_entropy_tail(matches: DataFrame) -> DataFrame:
    """Drop matches that end in twelve equal characters."""
    return matches.where(~has_constant_tail(F.col("value")))


def suppress_placeholder_context(matches: DataFrame) -> DataFrame:
    """Drop matches announced as an example by the text in front of them."""
    return matches.where(F.col("before").isNull() | ~is_placeholder_context(F.col("before")))


def suppress_natural_language(matches: DataFrame) -> DataFrame:
    """Drop matches of the broad assignment rules that read as language."""
    return matches.where(~F.col("rule_id").isin(*NOISY_RULE_IDS) | is_random(F.col("value")))


def score_randomness(matches: DataFrame) -> DataFrame:
    """Add ``bigram_fraction`` and ``is_random``."""
    return (matches.withColumn("bigram_fraction", bigram_fraction(F.col("value")))
            .withColumn("is_random", is_random(F.col("value"))))


def resolve_confidence(matches: DataFrame) -> DataFrame:
    """Suppressed means low; a broad rule on a random value means medium."""
    bumped = F.col("rule_id").isin(*NOISY_RULE_IDS) & is_random(F.col("value"))
    return matches.withColumn("confidence", F.when(F.col("suppressed_reason").isNotNull(), F.lit("low"))
                              .when(bumped, F.lit("medium")).otherwise(F.col("confidence")))


def mark_suppressed(matches: DataFrame) -> DataFrame:
    """Add ``suppressed_reason`` and settle ``confidence``; keeps every row."""
    reason = suppression_reason(F.col("value"), F.col("before"), F.col("rule_id"))
    never = F.col("category") == "injection"
    return resolve_confidence(matches.withColumn("suppressed_reason", F.when(~never, reason)))


def apply_suppression(matches: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """Keep reportable matches: all of them, or only the unsuppressed ones."""
    marked = mark_suppressed(matches)
    return marked if include_suppressed else marked.where(F.col("suppressed_reason").isNull())


def suppressed_counts(matches: DataFrame) -> DataFrame:
    """How many matches each reason suppressed (aggregated map-side first)."""
    return (mark_suppressed(matches).where(F.col("suppressed_reason").isNotNull())
            .groupBy("suppressed_reason").agg(F.count("*").alias("n")))
