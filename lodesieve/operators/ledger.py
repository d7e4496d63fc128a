"""Triage ledger: which fingerprints were acknowledged or dismissed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.functions.text import FINGERPRINT_PATTERN, strip_control_chars
from lodesieve.operators.redact import sanitize_note

LEDGER_SCHEMA = "fingerprint string, kind string, at timestamp, note string"
_STATE_TYPE = "struct<v:int,acks:map<string,variant>,dismissed:map<string,variant>>"


def upsert_ledger(ledger: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new ledger and the rejected updates.

    The last write per (kind, fingerprint) wins.  "Last" is an aggregate, not a
    window, so it is combined map-side.  Notes are masked before they are kept,
    and an update without a valid fingerprint is rejected.
    """
    valid = F.coalesce(F.col("fingerprint").rlike(FINGERPRINT_PATTERN), F.lit(False)) & F.col("kind").isin("ack", "dismiss")
    clean = updates.where(valid).withColumn("note", sanitize_note(F.col("note")))
    both = ledger.select("fingerprint", "kind", "at", "note").unionByName(clean.select("fingerprint", "kind", "at", "note"))
    latest = (both.groupBy("kind", "fingerprint")
              .agg(F.max(F.struct("at", "note")).alias("last"))
              .select("fingerprint", "kind", "last.at", "last.note"))
    return latest, updates.where(~F.coalesce(valid, F.lit(False)))


def resolutions(fingerprints: DataFrame, kind: str, at: str, note: str | None = None) -> DataFrame:
    """Updates that settle every fingerprint of a table (``fingerprint``): kind ``ack`` or ``dismiss``."""
    if kind not in ("ack", "dismiss"):
        raise ValueError(f"unknown kind of resolution: {kind}")
    return fingerprints.select("fingerprint", F.lit(kind).alias("kind"), F.to_timestamp(F.lit(at)).alias("at"),
                               F.lit(note).cast("string").alias("note"))


def acknowledge(ledger: DataFrame, fingerprints: DataFrame, at: str, note: str | None = None) -> DataFrame:
    """The ledger after these findings were rotated."""
    return upsert_ledger(ledger, resolutions(fingerprints, "ack", at, note))[0]


def dismiss(ledger: DataFrame, fingerprints: DataFrame, at: str, note: str | None = None) -> DataFrame:
    """The ledger after these findings were judged to be no secrets."""
    return upsert_ledger(ledger, resolutions(fingerprints, "dismiss", at, note))[0]


def load_ledger(states: DataFrame, col: str = "value") -> DataFrame:
    """Ledger rows from JSON state documents; bad entries are dropped one by one.

    A document that is not JSON or has another version counts as empty, and a time
    that cannot be read is NULL.
    """
    state = F.try_variant_get(F.try_parse_json(F.col(col)), "$", _STATE_TYPE)
    parsed = states.select(state.alias("s")).where(F.col("s.v") == 1)
    entries = None
    for field, kind in (("acks", "ack"), ("dismissed", "dismiss")):
        part = parsed.select(F.explode(F.col(f"s.{field}")).alias("fingerprint", "entry"), F.lit(kind).alias("kind"))
        entries = part if entries is None else entries.unionByName(part)
    is_object = F.schema_of_variant("entry").startswith("OBJECT")

    def text(field: str):
        value = F.try_variant_get("entry", f"$.{field}", "variant")
        plain = F.try_variant_get("entry", f"$.{field}", "string")
        return F.when(F.schema_of_variant(value) == "STRING", strip_control_chars(plain))

    return (entries.where(F.col("fingerprint").rlike(FINGERPRINT_PATTERN) & is_object)
            .select("fingerprint", "kind", F.try_to_timestamp(text("at")).alias("at"), text("note").alias("note")))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A new version of the ledger; an existing path is never overwritten, so readers of an older version stay safe."""
    ledger.select("fingerprint", "kind", "at", "note").write.mode("errorifexists").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)
