"""Detection quality: findings against planted truth.

``truth``: truth_id, class, kind, rule_family, file, line, value, distinct_group, exposure.
``found``: finding_id, file, line, value, rule_family.

Attribution has these tiers; a finding belongs to at most one instance:

1. same value: in the same file if it was planted there, otherwise anywhere;
2. same file and line: the first instance in truth order;
3. same file and family: only the most serious kind there (secrets before
   suppressed examples before chaff).

In tiers 1 and 3 the k-th finding of a group takes the k-th instance that is still
free, and findings beyond the last free one go to the first instance.  Ranks come
from ``chunked_row_number``: a value that is repeated everywhere does not end up
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.functions.text import basename
from lodesieve.operators.plant import HARD_CLASSES
from lodesieve.operators.rollup import beside, chunked_row_number
from lodesieve.session import checkpointed

LINES_PER_CHUNK = 4096
_KIND_RANK = {"secret": 0, "suppress": 1, "chaff": 2}


def file_matches(finding_file: Column, truth_file: Column) -> Column:
    """Same file by absolute path, by path suffix, or by bare name."""
    bare = ~F.contains(finding_file, F.lit("/"))
    return F.when(bare, basename(truth_file) == finding_file).otherwise(
        (truth_file == finding_file) | truth_file.endswith(F.concat(F.lit("/"), finding_file)))


def _suffixes(file: Column) -> Column:
    """A path and its ends: ``/a/b``, ``a/b``, ``b``; as many as the path is deep."""
    parts = F.split(file, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _resolved(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Findings with the file of the truth that theirs stands for, as in ``file_matches``; their own if there is none.

    An absolute path matches itself, a relative one the end of a path, a bare name
    the last part: all are keys of an equi-join.  A key of one file is settled by one
    join.  A key of several files is settled by equi-joins of falling rank, on the
    value and line, the value, the line, the family, or the key alone.  Each of them
    takes the first file, and each of its tables has one row per key, so a finding
    meets one row per rank however many files bear its name.
    """
    names = found.select(F.col("file").alias("_key")).distinct()
    files = (truth.select("file").distinct().select(F.col("file").alias("_to"), F.explode(_suffixes(F.col("file"))).alias("_key"))
             .join(names, "_key", "left_semi"))
    known = files.groupBy("_key").agg(F.min("_to").alias("_first"), (F.count("*") > 1).alias("_several"))
    keyed = found.join(known, F.col("file") == F.col("_key"), "left")
    plain = keyed.where(~F.coalesce("_several", F.lit(False))).withColumn("file", F.coalesce("_first", "file"))
    shared = files.join(known.where("_several").select("_key"), "_key", "left_semi")
    held = truth.join(shared, F.col("file") == F.col("_to")).select("_key", "_to", "value", "line", "rule_family")
    ranked = keyed.where("_several")
    ranks = (("value", "line"), ("value",), ("line",), ("rule_family",))
    for i, by in enumerate(ranks):
        ranked = ranked.join(held.groupBy("_key", *by).agg(F.min("_to").alias(f"_to{i}")), ["_key", *by], "left")
    ranked = ranked.withColumn("file", F.coalesce(*[f"_to{i}" for i in range(len(ranks))], "_first"))
    return plain.select(*found.columns).unionByName(ranked.select(*found.columns))


def _rank(df: DataFrame) -> DataFrame:
    """``k``, the position inside ``group`` along (file, line, id)."""
    lead = F.struct("file", F.floor(F.col("line") / LINES_PER_CHUNK))
    return chunked_row_number(df, ["group"], lead, ["file", "line", "id"], "k")


def _by_value_in_file() -> Column:
    return F.concat_ws("\n", F.lit("1a"), "value", "file")


def _by_value() -> Column:
    return F.concat_ws("\n", F.lit("1b"), "value")


def _by_family() -> Column:
    return F.concat_ws("\n", F.lit("3"), "file", "rule_family")


def _assign(findings: DataFrame, pool: DataFrame, claimed: DataFrame | None, tier: int) -> DataFrame:
    """k-th finding of a group to its k-th free instance, the rest to the first instance.

    Instances of groups without a finding are left out first: a value that was planted
    everywhere and is found nowhere is not ranked.
    """
    pool = pool.join(findings.select("group"), "group", "left_semi")
    free = pool if claimed is None else pool.join(claimed.select(F.col("truth_id").alias("id")), "id", "left_anti")
    free_at = _rank(free).select("group", "k", F.col("id").alias("free_id"))
    first = pool.groupBy("group").agg(F.min_by("id", F.struct("file", "line", "id")).alias("first_id"))
    return (_rank(findings).join(free_at, ["group", "k"], "left").join(first, "group")
            .select(F.col("id").alias("finding_id"), F.coalesce("free_id", "first_id").alias("truth_id"), F.lit(tier).alias("tier")))


def held(df: DataFrame) -> DataFrame:
    """Findings or truth written once, with hashes in place of raw values, for all that reads them."""
    return checkpointed(df.withColumn("value", F.sha2("value", 256)))


def attribute_findings(found: DataFrame, truth: DataFrame, are_held: bool = False) -> DataFrame:
    """``(finding_id, truth_id, tier)`` for every finding that could be attributed.

    A finding's file is first resolved to a file of the truth (``_resolved``).  The
    tier of a finding follows from which of its keys occur in the truth.  Both inputs and the result of tier 1 are read
    several times and are therefore checkpointed, with hashes in place of raw values;
    ``are_held`` says that both come from ``held`` already.
    """
    t = truth.select(F.col("truth_id").alias("id"), "file", "line", "value", "rule_family", "kind")
    f = found.select(F.col("finding_id").alias("id"), "file", "line", "value", "rule_family")
    if not are_held:
        t, f = held(t), held(f)
    f = _resolved(f, t)
    kind_rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in _KIND_RANK.items()], F.lit(3))

    pools = {name: t.select("id", "file", "line", key.alias("group"), kind_rank.alias("kind_rank"))
             for name, key in (("a", _by_value_in_file()), ("b", _by_value()), ("c", _by_family()))}
    has_value = F.col("value").isNotNull()
    g = f.select("*", F.when(has_value, _by_value_in_file()).alias("ka"), F.when(has_value, _by_value()).alias("kb"), _by_family().alias("kc"))
    for name, pool in pools.items():
        # One row per key, with how serious the most serious instance is.
        known = pool.groupBy("group").agg(F.min("kind_rank").alias(f"kind_{name}"))
        g = g.join(known.withColumnRenamed("group", f"k{name}"), f"k{name}", "left")
    g = g.join(t.groupBy("file", "line").agg(F.min("id").alias("line_truth")), ["file", "line"], "left")
    placed = checkpointed(g.select("id", "file", "line", "line_truth", "kind_c", F.when(F.col("kind_a").isNotNull(), F.col("ka"))
                                   .when(F.col("kind_b").isNotNull(), F.col("kb")).when(F.col("line_truth").isNotNull(), F.lit("2"))
                                   .when(F.col("kind_c").isNotNull(), F.col("kc")).alias("group")).where(F.col("group").isNotNull()))

    def tier(prefix: str) -> DataFrame:
        return placed.where(F.col("group").startswith(prefix)).select("id", "file", "line", "group", "kind_c")

    own_file = _assign(tier("1a"), pools["a"], None, 1)
    by_value = checkpointed(own_file.unionByName(_assign(tier("1b"), pools["b"], own_file, 1)))
    by_line = placed.where(F.col("group") == "2").groupBy(F.col("id").alias("finding_id")).agg(
        F.min("line_truth").alias("truth_id"), F.lit(2).alias("tier"))
    done = by_value.unionByName(by_line)
    top = pools["c"].groupBy("group").agg(F.min("kind_rank").alias("top"))
    serious = pools["c"].join(top, "group").where(F.col("kind_rank") == F.col("top")).drop("top")
    return done.unionByName(_assign(tier("3"), serious, done, 3))


def with_matches(truth: DataFrame, attributed: DataFrame) -> DataFrame:
    """Truth with ``matched``: did any finding land on the instance?"""
    hit = attributed.select("truth_id").distinct().withColumn("_hit", F.lit(True))
    return truth.join(hit, "truth_id", "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def in_scope(df: DataFrame, claimed: list[str] | None) -> DataFrame:
    """Only the classes a scanner claims to cover."""
    return df if claimed is None else df.where(F.col("class").isin(*claimed))


def score_per_class(matched: DataFrame, claimed: list[str] | None = None) -> DataFrame:
    """Sites and distinct values found per class; for the other kinds, false positives."""
    secret = F.col("kind") == "secret"
    return in_scope(matched, claimed).groupBy("class", "kind").agg(
        F.count("*").alias("sites"), F.count_if("matched").alias("sites_found"),
        F.countDistinct(F.when(secret, F.col("distinct_group"))).alias("distinct_total"),
        F.countDistinct(F.when(secret & F.col("matched"), F.col("distinct_group"))).alias("distinct_found"),
        F.count_if(~secret & F.col("matched")).alias("false_positives"))


def score_precision(matched: DataFrame, found: DataFrame, attributed: DataFrame, claimed: list[str] | None = None) -> DataFrame:
    """Precision over instances, with and without flags on documented examples; one row."""
    def flagged(kind: str) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col("matched"))

    instances = in_scope(matched, claimed).agg(
        flagged("secret").alias("secret_sites"), flagged("chaff").alias("chaff_flags"), flagged("suppress").alias("suppress_flags"))
    stray = (found.join(attributed.select("finding_id"), "finding_id", "left_anti").agg(F.count("*").alias("unplanted")))
    s, c, x, u = (F.col(n) for n in ("secret_sites", "chaff_flags", "suppress_flags", "unplanted"))
    return (beside(instances, stray)
            .withColumn("precision", F.try_divide(s, s + c + x + u))
            .withColumn("precision_without_suppress", F.try_divide(s, s + c + u)))


def score_overall(matched: DataFrame, claimed: list[str] | None = None) -> DataFrame:
    """Distinct credentials found, over all classes and without the hard ones; one row."""
    easy = ~F.col("class").isin(*HARD_CLASSES)

    def groups(cond: Column) -> Column:
        return F.countDistinct(F.when(cond, F.col("distinct_group")))

    secret = in_scope(matched, claimed).where(F.col("kind") == "secret")
    return secret.agg(groups(F.lit(True)).alias("total"), groups(F.col("matched")).alias("found"),
                      groups(easy).alias("headline_total"), groups(easy & F.col("matched")).alias("headline_found"))


def score_per_family(matched: DataFrame, claimed: list[str] | None = None) -> DataFrame:
    """Sites and sites found per rule family."""
    return (in_scope(matched, claimed).where(F.col("kind") == "secret").groupBy("rule_family")
            .agg(F.count("*").alias("sites"), F.count_if("matched").alias("sites_found")))


def score_reexposure(matched: DataFrame, claimed: list[str] | None = None) -> DataFrame:
    """Repeated exposures of known credentials that were found as well; one row."""
    again = in_scope(matched, claimed).where((F.col("kind") == "secret") & (F.col("exposure") == "re-exposed"))
    return again.agg(F.count("*").alias("sites"), F.count_if("matched").alias("sites_found"))


def score_audit(audited: DataFrame) -> DataFrame:
    """Confusion matrix of audited tool calls with an ``expected`` verdict."""
    return audited.groupBy("expected", F.col("blocked").alias("got")).agg(F.count("*").alias("n"))
