"""Pairing: the second half of a credential found next to the first.

An AWS key id, for example, is only usable together with a 40-character secret
that has no shape of its own.  It is reported when exactly one such candidate
stands near an unsuppressed anchor; two different candidates mean no answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.catalog.rules import PAIRED_LABELS
from lodesieve.functions.regex import to_java
from lodesieve.functions.text import has_constant_head, has_constant_tail, redact
from lodesieve.operators.suppress import suppression_reason


@dataclass(frozen=True)
class Pairing:
    """Anchor rules, the candidate next to them, and how many characters away."""

    anchors: tuple[str, ...]
    candidate: str
    window: int
    paired_id: str
    anchor_is_secret: bool


# Candidate shapes and distances.
PAIRINGS: tuple[Pairing, ...] = (
    Pairing(("aws_access_key_id", "aws_session_token"), r"\b[A-Za-z0-9/+]{40}\b", 400,
            "aws_secret_access_key_paired", False),
    Pairing(("planetscale_secret",), r"\b[a-z0-9]{12}\b", 100, "planetscale_id", True),
    Pairing(("mongodb_atlas_secret",), r"\bmdb_sa_id_[a-fA-F0-9]{24}\b", 150, "mongodb_atlas_client_id", True),
)

PAIR_WINDOWS = {rule: p.window for p in PAIRINGS for rule in p.anchors}


def nearby_candidate(around: Column, anchor: Column, candidate_regex: str) -> Column:
    """The only distinct candidate in ``around``, or NULL when none or several."""
    found = F.array_distinct(F.regexp_extract_all(around, F.lit(to_java(candidate_regex, exact_edges=True)), F.lit(0)))
    kept = F.filter(found, lambda v: (v != anchor) & ~has_constant_head(v) & ~has_constant_tail(v))
    return F.when(F.size(kept) == 1, F.get(kept, 0))


def with_pairs(matches: DataFrame) -> DataFrame:
    """Add ``paired_value``, ``paired_rule_id`` and ``paired_reason`` to anchors.

    Expects suppressed matches to be marked already: a suppressed anchor, or one
    that was found after decoding or joining, has no pair.
    """
    value, kind, rule, dead = "paired_value", "paired_rule_id", F.col("rule_id"), F.col("suppressed_reason").isNotNull()
    candidate, paired_id = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in PAIRINGS:
        is_anchor = rule.isin(*p.anchors) & ~dead & F.col("around").isNotNull()
        candidate = F.when(is_anchor, nearby_candidate(F.col("around"), F.col("value"), p.candidate)).otherwise(candidate)
        paired_id = F.when(is_anchor, F.lit(p.paired_id)).otherwise(paired_id)
    out = matches.withColumn(value, candidate).withColumn(kind, F.when(F.col(value).isNotNull(), paired_id))
    reason = suppression_reason(F.col(value), F.lit(None).cast("string"), F.lit(""))
    return out.withColumn("paired_reason", F.when(F.col(value).isNotNull(), reason))


def expand_pairs(matches: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """Turn a paired anchor into two rows that show each other's preview.

    Works row by row: the extra finding comes out of the same row as its anchor,
    so no join and no shuffle is needed.
    """
    usable = F.col("paired_value").isNotNull()
    if not include_suppressed:
        usable = usable & F.col("paired_reason").isNull()
    secret_anchor = F.col("rule_id").isin(*[r for p in PAIRINGS if p.anchor_is_secret for r in p.anchors])
    null = F.lit(None).cast("string")
    label = F.coalesce(*[F.when(F.col("paired_rule_id") == k, F.lit(v)) for k, v in PAIRED_LABELS.items()])

    def row(rule_id, label, confidence, value, reason, paired, secret_preview, key_preview, other_preview, other_label):
        return F.struct(
            rule_id.alias("rule_id"), label.alias("label"), confidence.alias("confidence"), value.alias("value"),
            reason.alias("suppressed_reason"), paired.alias("paired"),
            secret_preview.alias("paired_secret_preview"), key_preview.alias("paired_access_key_preview"),
            other_preview.alias("paired_other_preview"), other_label.alias("paired_other_label"))

    mate, own = redact(F.col("paired_value")), redact(F.col("value"))
    primary = row(F.col("rule_id"), F.col("label"), F.col("confidence"), F.col("value"), F.col("suppressed_reason"),
                  F.lit(None).cast("boolean"),
                  F.when(usable & ~secret_anchor, mate), null,
                  F.when(usable & secret_anchor, mate), F.when(usable & secret_anchor, F.lit("id")))
    extra = row(F.col("paired_rule_id"), label,
                F.when(F.col("paired_reason").isNull(), F.lit("high")).otherwise(F.lit("low")),
                F.col("paired_value"), F.col("paired_reason"), F.lit(True),
                null, F.when(~secret_anchor, own), F.when(secret_anchor, own),
                F.when(secret_anchor, F.lit("secret")))
    rows = F.when(usable, F.array(extra, primary)).otherwise(F.array(primary))
    replaced = {"rule_id", "label", "confidence", "value", "suppressed_reason",
                "paired_value", "paired_rule_id", "paired_reason"}
    kept = [c for c in matches.columns if c not in replaced]
    return matches.select(*kept, F.explode(rows).alias("r")).select(*kept, "r.*")


def pair_aws(matches: DataFrame) -> DataFrame:
    """AWS key ids with the secret next to them."""
    return _only(matches, PAIRINGS[0])


def pair_planetscale(matches: DataFrame) -> DataFrame:
    """PlanetScale secrets with the service-token id next to them."""
    return _only(matches, PAIRINGS[1])


def pair_mongodb_atlas(matches: DataFrame) -> DataFrame:
    """MongoDB Atlas secrets with the client id next to them."""
    return _only(matches, PAIRINGS[2])


def _only(matches: DataFrame, pairing: Pairing) -> DataFrame:
    return with_pairs(matches.where(F.col("rule_id").isin(*pairing.anchors)))
