"""Rollups of findings: per rule, per file, per fingerprint, and the gate.

All groupings aggregate map-side first.  Nothing is collected per group except
sets whose size does not grow with the data (sources of one fingerprint).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodesieve.catalog.guidance import GUIDANCE
from lodesieve.functions.text import basename, fingerprint
from lodesieve.session import checkpointed

STATUS_ORDER = ("pending", "acked", "dismissed")
DAY_MS = 86400000

GUIDANCE_SCHEMA = ("rule_id string, guidance_label string, rotate_url string, console_path string, steps array<string>, "
                   "revoke_note string, generic boolean")


def beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row of a small result.

    This is a cross join with one row, the only one of its kind here.
    """
    return rows.crossJoin(one_row)


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """Add ``fingerprint`` from rule, preview and base name."""
    return findings.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("preview"), basename(F.col("file"))))


def distinct_counts(expanded: DataFrame) -> DataFrame:
    """Distinct raw values against occurrences per rule; the difference was re-exposed.

    Works on matches that still hold values and returns only counts.  Spark groups
    by (rule, value) before it counts, so one rule with most of the rows is spread.
    """
    return expanded.groupBy("rule_id").agg(
        F.count("*").alias("occurrences"), F.countDistinct("value").alias("distinct_values")
    ).withColumn("re_exposed", F.col("occurrences") - F.col("distinct_values"))


SKETCH_BITS = 14  # log2 of a sketch's slots: counts off by 0.8 % as a rule, by 2.5 % hardly ever


def value_sketches(expanded: DataFrame, batch: Column) -> DataFrame:
    """``(batch, rule_id, n, values)``: occurrences and a sketch of the distinct values, one small row per batch and rule.

    Sketches hold hashes, so this table may be kept where raw values may not.
    """
    return expanded.groupBy(batch.alias("batch"), "rule_id").agg(F.count("*").alias("n"), F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("values"))


def merged_counts(sketches: DataFrame) -> DataFrame:
    """``distinct_counts`` of any set of batches from their sketches alone; nothing is scanned again."""
    return (sketches.groupBy("rule_id").agg(F.sum("n").alias("occurrences"), F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_values"))
            .withColumn("re_exposed", F.greatest(F.lit(0), F.col("occurrences") - F.col("distinct_values"))))


def totals(findings: DataFrame) -> DataFrame:
    """Counts per source and rule, per source, per rule and in all, from one pass over the findings.

    ``level`` says which: 0 source and rule, 1 source, 2 rule, 3 all; what a level sums over is null.
    """
    return findings.groupingSets([["source", "rule_id"], ["source"], ["rule_id"], []], "source", "rule_id").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("confidence") == "low").alias("n_low"),
        F.max("mtime_ms").alias("newest_mtime_ms"))


def rule_summary(findings: DataFrame) -> DataFrame:
    """Findings per rule, most frequent first, with how many were encoded or split."""
    return (findings.groupBy("rule_id").agg(
        F.min("label").alias("label"),
        F.count("*").alias("n"),
        F.count_if(F.col("encoding").isNotNull()).alias("n_encoded"),
        F.count_if(F.col("span_lines").isNotNull()).alias("n_split"),
        F.count_if(F.col("confidence") == "low").alias("n_low"))
        .orderBy(F.desc("n"), "rule_id"))


def file_summary(findings: DataFrame, top: int = 15) -> DataFrame:
    """The files with most findings; ``files_total`` tells how many there are in all."""
    per_file = findings.groupBy("source", "file").agg(F.count("*").alias("n"), F.max("mtime_ms").alias("newest_mtime_ms"))
    total = per_file.agg(F.count("*").alias("files_total"))
    return beside(per_file.orderBy(F.desc("n"), "source", "file").limit(top), total)


def with_ledger(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``status``, ``resolved_at`` and ``resolved_note``; an acknowledgement beats a dismissal.

    The ledger has one row per (kind, fingerprint).  It is reduced to one row per
    fingerprint first, so the join never multiplies findings; AQE broadcasts it
    while it is small.
    """
    acked, dismissed = F.col("kind") == "ack", F.col("kind") == "dismiss"
    one = ledger.groupBy("fingerprint").agg(
        F.max_by(F.struct("at", "note"), F.col("at")).alias("any"),
        F.max_by(F.struct("at", "note"), F.when(acked, F.col("at"))).alias("ack"),
        F.count_if(acked).alias("n_ack"), F.count_if(dismissed).alias("n_dismiss"))
    joined = findings.join(one, "fingerprint", "left")
    status = F.when(F.col("n_ack") > 0, "acked").when(F.col("n_dismiss") > 0, "dismissed").otherwise("pending")
    entry = F.when(F.col("n_ack") > 0, F.col("ack")).otherwise(F.col("any"))
    return (joined.withColumn("status", status).withColumn("_e", entry)
            .withColumn("resolved_at", F.col("_e.at")).withColumn("resolved_note", F.col("_e.note"))
            .drop("any", "ack", "n_ack", "n_dismiss", "_e"))


def guidance_table(spark: SparkSession) -> DataFrame:
    """What to do about each rule; one row per catalogue rule, hence safe to broadcast."""
    return F.broadcast(spark.createDataFrame(GUIDANCE, GUIDANCE_SCHEMA))


def explain(spark: SparkSession, rule_id: str) -> DataFrame:
    """What a rule looks for and what to do about a finding of it; one row, also for an unknown rule."""
    asked = spark.range(1).select(F.lit(rule_id).alias("rule_id"))
    return with_guidance(asked, guidance_table(spark))


def with_guidance(findings: DataFrame, guidance: DataFrame) -> DataFrame:
    """Add guidance; an unknown rule gets a generic entry that says so.

    The table of this package is marked for broadcast, as its size is fixed; another
    one is joined as the optimizer sees fit.
    """
    joined = findings.join(guidance, "rule_id", "left")
    missing = F.col("guidance_label").isNull()
    return (joined
            .withColumn("generic", F.coalesce("generic", F.lit(True)))
            .withColumn("console_path", F.when(missing, "No rotation guidance is shipped for this rule id yet").otherwise(F.col("console_path")))
            .withColumn("guidance_label", F.coalesce("guidance_label", "rule_id")))


def known_fingerprints(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings that the ledger already settles."""
    return findings.join(ledger.select("fingerprint").distinct(), "fingerprint", "left_semi")


def suppress_known(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings that were neither acknowledged nor dismissed."""
    return findings.join(ledger.select("fingerprint").distinct(), "fingerprint", "left_anti")


def _verdict() -> Column:
    """What a live check has said: one active sighting outweighs all others."""
    said = F.col("verified")
    return F.when(F.count_if(said == "active") > 0, "active").when(F.count_if(said == "invalid") > 0, "invalid").otherwise(F.max(said)).alias("verified")


def rotation_rollup(findings: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """One row per fingerprint: what, how often, where, since when, settled or not.

    "First" means first by (source, file, line).  A fingerprint contains the base
    name of its file, so its set of names has one element; its sources are bounded
    by the registry.  A column ``verified`` is kept, and an invalid value is dead.
    """
    seq = F.struct("source", "file", "line")
    checked = "verified" in findings.columns

    def first_of(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c)

    grouped = findings.groupBy("fingerprint").agg(
        F.min("rule_id").alias("rule_id"), F.min("label").alias("label"), F.min("preview").alias("preview"),
        F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set("rel_file")).alias("files"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max("mtime_ms").alias("last_seen_ms"),
        first_of("paired_secret_preview"), first_of("paired_access_key_preview"), first_of("paired_other_preview"),
        F.min_by(F.col("paired_other_label"), F.when(F.col("paired_other_preview").isNotNull(), seq)).alias("paired_other_label"),
        first_of("jwt_expires_at_ms"), *([_verdict()] if checked else []))
    dead = F.coalesce(F.col("jwt_expires_at_ms") < now_ms, F.lit(False))
    if checked:
        dead = dead | F.coalesce(F.col("verified") == "invalid", F.lit(False))
    return with_ledger(grouped, ledger).withColumn("confirmed_dead", dead)


def prioritise(rollup: DataFrame) -> DataFrame:
    """Most urgent first: pending before settled, active and paired before the rest, dead ones last."""
    status = F.when(F.col("status") == "pending", 0).when(F.col("status") == "acked", 1).otherwise(2)
    paired = (F.col("paired_secret_preview").isNotNull() | F.col("paired_access_key_preview").isNotNull()
              | F.col("paired_other_preview").isNotNull())
    active = F.col("verified") == "active" if "verified" in rollup.columns else F.lit(False)
    dead = F.col("confirmed_dead")
    if "verified" in rollup.columns:
        dead = dead | (F.col("verified") == "invalid")
    score = F.when(active, -2).when(paired, -1).when(dead, 1).otherwise(0)
    return rollup.withColumn("priority", score).orderBy(status, "priority", "rule_id", "fingerprint")


def top_entries(ordered: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` entries and how many were left out."""
    if n < 1:
        raise ValueError("at least one entry is shown")
    total = ordered.agg(F.count("*").alias("total"))
    return (beside(ordered.limit(n), total)
            .withColumn("truncated", F.col("total") > n)
            .withColumn("truncated_count", F.greatest(F.col("total") - n, F.lit(0))).drop("total"))


def display_entries(rollup: DataFrame, shown: int = 12) -> DataFrame:
    """The entries a short report shows, grouped by rule.

    Rules with a pending entry come first, then rules by label; inside a rule the
    entries keep their priority.  The limit counts entries, not rules.
    """
    groups = rollup.groupBy("rule_id").agg(
        F.min("label").alias("group_label"), F.max(F.when(F.col("status") == "pending", 1).otherwise(0)).alias("open"))
    # One row per rule; AQE broadcasts it by its measured size.
    entries = prioritise(rollup).join(groups, "rule_id")
    status = F.when(F.col("status") == "pending", 0).when(F.col("status") == "acked", 1).otherwise(2)
    return (entries.orderBy(F.desc("open"), "group_label", "rule_id", status, "priority", "fingerprint")
            .limit(shown).drop("group_label", "open"))


def pending_summary(rollup: DataFrame) -> DataFrame:
    """Totals over a rollup: findings, distinct, pending, acked, dismissed, confirmed dead."""
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    return rollup.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("findings"), F.count("*").alias("distinct_findings"),
        n(F.col("status") == "pending", "pending"), n(F.col("status") == "acked", "acked"),
        n(F.col("status") == "dismissed", "dismissed"),
        n((F.col("status") == "pending") & F.col("confirmed_dead"), "confirmed_dead"))


def age_days(findings: DataFrame, now_ms: int) -> DataFrame:
    """Age in days of the oldest and the newest finding; one row."""
    def days(ms: Column) -> Column:
        return F.greatest(F.lit(0), F.floor((F.lit(now_ms) - ms) / DAY_MS)).cast("bigint")

    oldest = F.least(F.min("mtime_ms"), F.lit(now_ms))
    return findings.agg(days(oldest).alias("oldest_days"), days(F.max("mtime_ms")).alias("newest_days"))


def gate(findings: DataFrame, integrity: DataFrame | None = None, ledger: DataFrame | None = None,
         allow_acked: bool = False) -> DataFrame:
    """Should a pipeline fail?  Any open finding or any integrity warning; notes never count."""
    open_findings = suppress_known(findings, ledger) if allow_acked and ledger is not None else findings
    found = open_findings.agg(F.count("*").alias("open_findings"))
    if integrity is None:
        return found.withColumn("warnings", F.lit(0).cast("bigint")).withColumn("fails", F.col("open_findings") > 0)
    warned = integrity.agg(F.count_if(F.col("severity") == "warn").alias("warnings"))
    return beside(found, warned).withColumn("fails", (F.col("open_findings") > 0) | (F.col("warnings") > 0))


def integrity_summary(integrity: DataFrame, checked: DataFrame) -> DataFrame:
    """Warnings and notes, and how many locations were checked or absent; one row."""
    counts = integrity.agg(F.count_if(F.col("severity") == "warn").alias("warnings"),
                           F.count_if(F.col("severity") == "info").alias("infos"))
    files = checked.agg(F.count_if(F.col("status") == "checked").alias("checked"),
                        F.count_if(F.col("status") == "absent").alias("absent"))
    return beside(counts, files)


def scan_summary(findings: DataFrame, coverage: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Headline numbers of a scan; one row."""
    found = findings.agg(F.count("*").alias("finding_count"), F.countDistinct("source", "file").alias("files_with_findings"))
    readable = F.col("status").isin("complete", "partial")
    read = coverage.agg(
        F.count_if(readable).alias("files_scanned"),
        F.coalesce(F.sum(F.when(readable, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_scanned"),
        F.count_if(F.col("reason").isNotNull()).alias("unreadable_files"),
        F.countDistinct(F.when(readable, F.col("source"))).alias("sources_scanned"))
    out = beside(found, read)
    return out if suppressed is None else beside(out, suppressed)


def chunked_row_number(df: DataFrame, keys: list[str], chunk: Column, order: list[Column | str], name: str) -> DataFrame:
    """``row_number`` per key that spreads a hot key over many tasks.

    ``chunk`` must not decrease along ``order``.  Rows are numbered inside
    (key, chunk); the rows in earlier chunks of the key are added from a small
    table of counts.  The result equals a plain ``row_number`` over ``keys``.
    """
    df = df.withColumn("_chunk", chunk)
    inside = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order))
    counts = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_chunk", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    numbered = df.withColumn("_inside", inside).join(offsets, [*keys, "_chunk"])
    return numbered.withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint")).drop("_chunk", "_inside", "_offset")


def spread_row_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` per key in which a hot key is truly spread: rows are range partitioned by key and order.

    Each partition numbers its own rows, one offset per partition shifts them (the
    driver sees as many numbers as there are partitions), and the first number of a
    key, an aggregate, is subtracted.  ``order`` should tell rows apart.
    """
    spark, by = df.sparkSession, [*keys, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    shifts, total = [], 0
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        shifts.append((row["part"], total - (row["part"] << 33)))
        total += row["count"]
    shift = F.broadcast(spark.createDataFrame(shifts, "_part bigint, _shift bigint"))  # one row per partition
    at = placed.withColumn("_part", part).join(shift, "_part").withColumn("_at", F.col("_at") + F.col("_shift")).drop("_part", "_shift")
    firsts = at.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_at").alias("_first"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return at.join(firsts, same).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *[f"_{k}" for k in keys])


def reexposure_counts(findings: DataFrame, seq: str | list[str]) -> DataFrame:
    """Batch form of the watch: is this the first time a (rule, preview) is seen, and which time is it?"""
    numbered = spread_row_number(findings, ["rule_id", "preview"], [seq] if isinstance(seq, str) else seq, "nth")
    return numbered.withColumn("event", F.when(F.col("nth") == 1, "finding").otherwise("reexposure"))
