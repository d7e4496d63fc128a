"""Inputs shared by the registered queries, all derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.operators.extract import explode_hits, passes_gate, rule_hits
from lodesieve.operators.pairing import PAIR_WINDOWS
from lodesieve.operators.plant import planted_text, with_plants
from lodesieve.operators.suppress import mark_suppressed
from lodesieve.catalog.rules import DEFAULT_RULES, NOISY_RULES
from lodesieve.plans.scan import ScanOptions, expanded_matches, findings_of, scan_files
from lodesieve.session import shared_folder
from lodesieve.sinks.findings import save_findings
from lodesieve.sources.records import as_files, explode_lines, spread

# A fixed clock: ages and expiries must not depend on the day a query runs.
NOW_MS = 1700000000000 + 2000 * 3600000
FIRST_MTIME_MS = 1700000000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_plants(documents(spark, sf_dir))
    return df.select("doc_id", "source", planted_text(df).alias("text"))


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mtime = F.lit(FIRST_MTIME_MS) + F.col("doc_id") * 3600000
    return as_files(planted_documents(spark, sf_dir), "doc_id", "text", F.col("source"), mtime)


def planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(planted_files(spark, sf_dir))


def raw_matches(spark: SparkSession, sf_dir: str, noisy: bool = True) -> DataFrame:
    """Matches of the rules on the planted lines, with reason and confidence."""
    rules = DEFAULT_RULES + NOISY_RULES if noisy else DEFAULT_RULES
    text = F.col("text")
    gated = planted_lines(spark, sf_dir).where(passes_gate(text, rules))
    hits = explode_hits(gated, rule_hits(text, rules, PAIR_WINDOWS))
    return mark_suppressed(hits.withColumn("category", F.lit("secret")))


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted findings of the raw pass, pairs included."""
    return findings_of(expanded_matches(raw_matches(spark, sf_dir), False))


# Every pass there is; seed phrases need a word list and stay out.
ALL_PASSES = ScanOptions(include_noisy=True, include_pii=True, include_injection=True)


def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all passes over the planted files, scanned once and written; rollups and reports read the table."""
    name = f"findings_{uuid.uuid4().hex}"
    return save_findings(scan_files(planted_files(spark, sf_dir), ALL_PASSES), name, f"{shared_folder(spark)}/{name}")


def ledger_for(findings: DataFrame) -> DataFrame:
    """A ledger that settles part of the findings, by the last digit of the fingerprint."""
    digit = F.right("fingerprint", F.lit(1))
    kinds = F.concat(F.when(digit.isin("0", "1", "2"), F.array(F.lit("ack"))).otherwise(F.array().cast("array<string>")),
                     F.when(digit.isin("2", "3", "4"), F.array(F.lit("dismiss"))).otherwise(F.array().cast("array<string>")))
    return (findings.select("fingerprint").distinct()
            .select("fingerprint", F.explode(kinds).alias("kind"))
            .select("fingerprint", "kind", F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("at"),
                    F.concat(F.lit("note "), F.right("fingerprint", F.lit(4))).alias("note")))
