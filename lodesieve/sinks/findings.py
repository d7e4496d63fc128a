"""Outputs: finding tables and SARIF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _refuse_raw(findings: DataFrame) -> None:
    leaked = {"value", "value_hash", "around", "before"} & set(findings.columns)
    if leaked:
        raise ValueError(f"raw values must not be written: {sorted(leaked)}")


def save_findings(findings: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write redacted findings once, as a table bucketed by fingerprint; what it returns reads that table.

    Rollups, ledger joins, the gate and reports then read findings and not the text, and
    whatever groups or joins by fingerprint needs no exchange.  Rows come to their bucket
    by a rebalance, so a fingerprint with a third of all findings is written by several
    tasks; to read it back evenly, switch ``spark.sql.sources.bucketing.enabled`` off.
    """
    _refuse_raw(findings)
    buckets = buckets or int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (findings.hint("rebalance", buckets, "fingerprint").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "fingerprint").sortBy("fingerprint").saveAsTable(table))
    return findings.sparkSession.table(table)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write redacted findings, one directory per rule.

    Refuses tables that still hold raw values.  Rows are rebalanced by rule before
    the write: AQE splits a rule with most findings, or one huge file, over many
    tasks by measured size, and a small rule gets few files.
    """
    _refuse_raw(findings)
    (findings.hint("rebalance", "rule_id")
     .write.mode(mode).partitionBy("rule_id").format(fmt).save(path))


# Level and severity per confidence.
_LEVELS = {"high": ("error", "9.0"), "medium": ("warning", "6.0"), "low": ("note", "3.0")}


def _by_confidence(index: int, default: str):
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for confidence, values in _LEVELS.items():
        out = out.when(F.col("confidence") == confidence, F.lit(values[index]))
    return out.otherwise(F.lit(default))


def to_sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF 2.1.0 results, one struct per row; a region only where the line is known."""
    location = F.struct(F.struct(
        F.struct(F.col("rel_file").alias("uri")).alias("artifactLocation"),
        F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region")).alias("physicalLocation"))
    return findings.select(
        F.col("rule_id").alias("ruleId"), _by_confidence(0, "warning").alias("level"),
        F.struct(F.concat("label", F.lit(" (redacted: "), "preview", F.lit(")")).alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"),
        F.struct("source", "confidence").alias("properties"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The rule entries that the results refer to."""
    return (findings.groupBy("rule_id").agg(F.min("label").alias("name"), F.min("confidence").alias("confidence"))
            .select(F.col("rule_id").alias("id"), "name", F.struct(F.col("name").alias("text")).alias("shortDescription"),
                    F.struct(_by_confidence(1, "3.0").alias("security-severity")).alias("properties")))


def sarif_document(findings: DataFrame, tool: str, at_most: int = 25_000) -> DataFrame:
    """One SARIF document, ``document``, for a result that fits one: at most ``at_most`` results, else an error.

    Larger results go to ``write_sarif``, as lines.
    """
    results, rules = to_sarif_results(findings), sarif_rules(findings)
    n = results.limit(at_most + 1).count()
    if n > at_most:
        raise ValueError(f"over {at_most} results; write them with write_sarif")
    by = F.array_sort(F.collect_list(F.struct("ruleId", "partialFingerprints", "locations", "level", "message", "properties")))
    run = results.agg(by.alias("results")).crossJoin(rules.agg(F.array_sort(F.collect_list(F.struct("id", "name", "shortDescription", "properties"))).alias("rules")))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))
    return run.select(F.to_json(document).alias("document"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """Write SARIF results as JSON lines, with the rule entries next to them.

    A run of any size is a directory of lines; no document is put together on one
    machine.
    """
    to_sarif_results(findings).write.mode("overwrite").json(f"{path}/results")
    sarif_rules(findings).coalesce(1).write.mode("overwrite").json(f"{path}/rules")
