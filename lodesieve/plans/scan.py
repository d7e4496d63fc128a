"""The scan: records in, redacted findings out.

All per-record passes share one read of the input and one ``explode``; the
boundary pass is the only one that looks at two records.  Raw values exist
between extraction and ``findings_of`` and are dropped there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodesieve.catalog.rules import (CHATML_RULE, DEFAULT_RULES, NOISY_RULES, OVERRIDE_PHRASE_RULE, PII_RULES,
                                     SEED_PHRASE_RULE, ZERO_WIDTH_RULE, Rule)
from lodesieve.functions.text import basename, fingerprint, jwt_expires_at_ms, redact
from lodesieve.operators.boundary import both_lines, content_of, record_seams, seam_array, seam_gate, seam_hits, seam_windows, straddling
from lodesieve.operators.decode import DECODE_GATE, decoded_hits
from lodesieve.operators.extract import explode_hits, is_quiet, may_match, passes_gate, rule_hits
from lodesieve.operators.injection import injection_hits
from lodesieve.operators.pairing import PAIR_WINDOWS, expand_pairs, with_pairs
from lodesieve.operators.pii import narrow_seed_phrases, pii_hits
from lodesieve.operators.suppress import mark_suppressed
from lodesieve.session import checkpointed
from lodesieve.sources.records import lines_of, read_marked_lines, split_starts, with_line_numbers

FINDING_COLUMNS = ("rule_id", "label", "confidence", "suppressed_reason", "category", "pass", "source", "file", "rel_file",
                   "line", "preview", "mtime_ms", "encoding", "span_lines", "paired", "paired_secret_preview",
                   "paired_access_key_preview", "paired_other_preview", "paired_other_label", "jwt_expires_at_ms", "fingerprint")


@dataclass(frozen=True)
class ScanOptions:
    """What to look for and what to report."""

    rules: tuple[Rule, ...] = DEFAULT_RULES
    include_noisy: bool = False
    include_suppressed: bool = False
    include_pii: bool = False
    include_injection: bool = False
    wordlist: tuple[str, ...] | None = None

    @property
    def secret_rules(self) -> tuple[Rule, ...]:
        return self.rules + NOISY_RULES if self.include_noisy else self.rules


def _or_none(hits: Column) -> Column:
    return F.coalesce(hits, F.array().cast("array<struct<rule_id:string,label:string,confidence:string,value:string,"
                                           "before:string,around:string,encoding:string,pass:string>>"))


def _injection_rules(options: ScanOptions) -> tuple[Rule, ...]:
    return (CHATML_RULE, ZERO_WIDTH_RULE) + ((OVERRIDE_PHRASE_RULE,) if options.include_noisy else ())


def _gate_rules(options: ScanOptions) -> tuple[Rule, ...]:
    rules = options.secret_rules
    if options.include_pii:
        rules += PII_RULES + ((SEED_PHRASE_RULE,) if options.wordlist else ())
    if options.include_injection:
        rules += _injection_rules(options)
    return rules


def record_hits(text: Column, options: ScanOptions) -> Column:
    """Array of everything found in one record: raw, decoded, personal data, injection."""
    high = tuple(r for r in options.secret_rules if r.confidence == "high")
    parts = [(passes_gate(text, options.secret_rules), rule_hits(text, options.secret_rules, PAIR_WINDOWS))]
    if options.include_pii:
        parts.append((passes_gate(text, PII_RULES), pii_hits(text)))
        if options.wordlist:
            parts.append((passes_gate(text, (SEED_PHRASE_RULE,)), rule_hits(text, (SEED_PHRASE_RULE,), pass_name="pii")))
    if options.include_injection:
        parts.append((may_match(text, _injection_rules(options)), injection_hits(text, options.include_noisy)))
    gated = [_or_none(F.when(gate, hits)) for gate, hits in parts]
    return F.concat(*gated, _or_none(decoded_hits(text, high)))


def record_gate(text: Column, options: ScanOptions) -> Column:
    """May ``record_hits`` find anything?"""
    rules = _gate_rules(options)
    # Runs of base64 characters are longer than any word of prose.
    return ~is_quiet(text, rules) & (passes_gate(text, rules) | text.rlike(DECODE_GATE))


def classify(matches: DataFrame, options: ScanOptions) -> DataFrame:
    """Add category and suppression reason; settle seed phrases and confidence."""
    if options.include_pii and options.wordlist:
        matches = narrow_seed_phrases(matches, list(options.wordlist))
    category = F.when(F.col("pass").isin("pii", "injection"), F.col("pass")).otherwise("secret")
    return mark_suppressed(matches.withColumn("category", category))


def all_matches(records: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Matches of every pass with raw values, category and suppression reason.

    One row per match; a split value is one row here and becomes two findings.
    Two reads of the input: one for everything inside a record, one for seams.
    """
    text = F.col("text")
    inside = explode_hits(records.where(record_gate(text, options)), record_hits(text, options))
    return classify(inside.unionByName(straddling(record_seams(records, options.secret_rules), options.secret_rules)), options)


def all_matches_of_files(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The same for rows that each hold a whole file: one read and no shuffle."""
    text = F.col("text")
    lines = (files.select("source", "file", "mtime_ms", lines_of(text).alias("lines"))
             .select("source", "file", "mtime_ms", F.posexplode(
                 F.arrays_zip("lines", seam_array(F.col("lines"), options.secret_rules).alias("seams"))).alias("i", "z"))
             .select("source", "file", (F.col("i") + 1).alias("line"), "mtime_ms",
                     F.col("z.lines").alias("text"), F.col("z.seams").alias("seam")))
    over = seam_hits(F.col("seam.tail"), F.col("seam.head"), options.secret_rules)
    gate = record_gate(text, options) | F.coalesce(
        seam_gate(F.col("seam.tail"), F.col("seam.head"), options.secret_rules), F.lit(False))
    return classify(explode_hits(lines.where(gate), F.concat(record_hits(text, options), _or_none(over))), options)


def expanded_matches(matches: DataFrame, include_suppressed: bool) -> DataFrame:
    """Reportable rows: the partner of a pair and the second line of a split value included."""
    paired = with_pairs(matches)
    live = paired if include_suppressed else paired.where(F.col("suppressed_reason").isNull())
    return both_lines(expand_pairs(live, include_suppressed))


def findings_of(expanded: DataFrame, by_value: bool = False) -> DataFrame:
    """Redacted findings with a fingerprint; the raw value ends here.

    ``by_value`` adds ``value_hash``, which tells values of one preview apart; no sink takes it.
    """
    if by_value:
        expanded = expanded.withColumn("value_hash", F.sha2("value", 256))
    preview, rel = redact(F.col("value")), basename(F.col("file"))
    expires = F.when((F.col("rule_id") == "jwt") & (F.col("pass") == "raw") & F.col("suppressed_reason").isNull(),
                     jwt_expires_at_ms(F.col("value")))
    df = (expanded.withColumn("preview", preview).withColumn("rel_file", rel)
          .withColumn("jwt_expires_at_ms", expires)
          .withColumn("pass", F.when(F.col("paired"), "paired").otherwise(F.col("pass"))))
    return (df.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("preview"), F.col("rel_file")))
            .select(*FINDING_COLUMNS, *["value_hash"] * by_value))


def scan(records: DataFrame, options: ScanOptions = ScanOptions(), by_value: bool = False) -> DataFrame:
    """Findings of a set of records."""
    return findings_of(expanded_matches(all_matches(records, options), options.include_suppressed), by_value)


def scan_files(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of rows that each hold a whole file (``source, file, text, mtime_ms``).

    Neighbouring lines are paired inside the row, so the whole scan is one narrow
    stage: no shuffle between the table and the findings.
    """
    return findings_of(expanded_matches(all_matches_of_files(files, options), options.include_suppressed))


def scan_text_files(spark: SparkSession, paths: str | list[str], source: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of text files of any size, with true line numbers.

    Files are scanned split by split.  A first, light pass counts the lines of each split
    and keeps its first and last line; only findings, and the seams between splits, meet
    that table.  No line of text is shuffled.
    """
    marked = read_marked_lines(spark, paths, source)
    splits = checkpointed(split_starts(marked))
    text = F.col("text")
    inside = explode_hits(marked.where(record_gate(text, options)), record_hits(text, options))
    following = F.lead("first_text").over(W.partitionBy("source", "file").orderBy("split_start"))
    edges = (splits.withColumn("next_text", following).where((F.length("last_text") > 0) & (F.length("next_text") > 0))
             .select("source", "file", F.col("last").alias("line"), "mtime_ms", F.explode(F.array(F.struct(
                 seam_windows(content_of(F.col("last_text")), options.secret_rules)["tail"].alias("tail"),
                 seam_windows(content_of(F.col("next_text")), options.secret_rules)["head"].alias("head")))).alias("w"))
             .select("source", "file", "line", "mtime_ms", "w.*"))
    over = straddling(record_seams(marked, options.secret_rules).unionByName(edges), options.secret_rules)
    matches = classify(with_line_numbers(inside.unionByName(over), splits), options)
    return findings_of(expanded_matches(matches, options.include_suppressed))


def suppressed_count(matches: DataFrame) -> DataFrame:
    """How many matches were suppressed, partners of pairs included; one row."""
    paired = with_pairs(matches)
    n = F.count_if(F.col("suppressed_reason").isNotNull()) + F.count_if(F.col("paired_reason").isNotNull())
    return paired.agg(n.alias("suppressed_count"))
