"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source asks for the same number of copies, target / source size; its whole part is granted, and the
fraction is rounded dependently: two documents with open fractions meet, and words (fraction x size) move at random from
one to the other until one fraction is 0 or 1. The expected copies stay as asked, and the words of the pair do not change.
Buckets of a source do this first; what stays open, one document a bucket, meets in the next level of a reduction tree,
and the last of a source is rounded by itself. So a source misses its target by less than one document.

Documents go from long to short, so that the last one is short as a rule. All draws are digests of seed and id, and
buckets depend on ids alone: reruns agree. Hot sources have more buckets, each of ``BUCKET`` different documents on average.

Rows that agree in doc_id, source and text are one class, which asks for the copies of all its rows together and is rounded as
one document; its copies are dealt out evenly again, so no row is taken more often than ``CAP`` times, and no bucket grows
with repeated rows. A null text has no words and takes none; a null source is a source of its own, last; no rows give no rows.
Texts of any length are counted whole; ``mix`` carries all columns, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesieve.llm.common import WORD, id_key, numbered, packed, saved, text_key

BUCKET = 4096   # documents that meet in a bucket, on average
FAN_IN = 256    # open documents that meet in a bucket of the next level, at most
CAP = 3         # no document is taken more often
DEALT = 1 << 16 # rows of a class that one task deals out at once
_EPS = 1e-9


def words_of(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), text_key().alias("text_key"))


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target): weights 1, 2, 3 by code point, null last, reshared above ``cap`` times the size.

    The water level is found by rounds that pass two sums each through the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).withColumn("_null", F.col("source").isNull())
    ranked = saved(numbered(totals, ["_null", "source"], "_rank").withColumn("weight", F.col("_rank") % 3 + 1).drop("_null", "_rank"))
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(full, limit).otherwise(0)).alias("taken"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
                         F.sum(full.cast("int")).alias("n")).first()
        if row["n"] is None or row["n"] == before or not row["open"]:
            break
        before, level = row["n"], (total - row["taken"]) / row["open"]
    if row["n"] is not None and not row["open"]:
        level = math.inf
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _draw(seed: int, ids: list, level: int) -> np.ndarray:
    """A number in [0, 1) for each id, by a splitmix of it."""
    with np.errstate(over="ignore"):
        x = np.array(ids, dtype=np.uint64) + np.uint64((seed * 2654435761 + level * 40503 + 1) % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def settle(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Shares after all pairs have met: 0 or 1 but for one at most."""
    out = shares.copy()
    held = -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held] * sizes[held], out[i] * sizes[i]
        up, down = min(sizes[held] - a, b), min(a, sizes[i] - b)
        if draws[i] * (up + down) < down:  # words go to the one that is held
            a, b, moved = a + up, b - up, up
        else:
            a, b, moved = a - down, b + down, down
        for j, words in ((held, a), (i, b)):
            share = words / sizes[j]
            out[j] = 0.0 if share < _EPS else 1.0 if share > 1 - _EPS else share
        held = held if 0 < out[held] < 1 else i if 0 < out[i] < 1 else -1
    return out


def _meet(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        draws = _draw(seed, pdf["item"].to_numpy().astype(np.int64).view(np.uint64).tolist(), level)
        shares = settle(pdf["size"].to_numpy(np.float64), pdf["share"].to_numpy(np.float64), draws)
        if last:
            alone = _draw(seed + 1, pdf["item"].to_numpy().astype(np.int64).view(np.uint64).tolist(), level)
            shares = np.where((shares > 0) & (shares < 1), alone < shares, shares).astype(np.float64)
        return pdf.assign(share=shares)

    return run


def class_copies(sizes: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, text_key, size, n, source_size, target, copies) of each class of equal rows; n rows take copies in all."""
    targets = source_targets(sizes)
    classes = sizes.groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("n"))
    asked = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    near = F.floor(asked + _EPS)
    share = F.when(asked - near < _EPS, 0.0).otherwise(asked - near)
    ids = sizes.schema["doc_id"].dataType  # as text on the way through pandas, where a null would make ids inexact
    joined = (classes.withColumn("doc_id", F.col("doc_id").cast("string")).join(targets.withColumnRenamed("source", "_source"), classes["source"].eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("whole", near.cast("long")).withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))
              .withColumn("item", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
              .withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET))
              .withColumn("bucket", F.pmod(F.xxhash64("item"), F.col("buckets"))).drop("n_docs"))
    most = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    width, level, done, now = math.ceil(most / BUCKET), 0, None, joined
    while True:
        last = width <= 1
        now = saved(now.groupBy("source", "bucket").applyInPandas(_meet(seed, level, last), now.schema))
        settled = now.where("share <= 0 or share >= 1")
        done = settled if done is None else done.union(settled)
        if last:
            break
        now = now.where("share > 0 and share < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        width, level = math.ceil(width / FAN_IN), level + 1
    return done.select(F.col("doc_id").cast(ids).alias("doc_id"), "source", "text_key", "size", "n", "source_size", "target", (F.col("whole") + F.col("share").cast("int")).alias("copies"))


def _of_row(i: Column) -> Column:
    """The copies of the i-th row of a class."""
    each = F.floor(F.col("copies") / F.col("n"))
    return (each + (i < F.col("copies") - each * F.col("n")).cast("long")).cast("int")


def copies(sizes: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of ``sizes(doc_id, source, size, text_key)`` with source_size, target and copies."""
    classes = saved(class_copies(sizes, seed))
    columns = ["doc_id", "source", "text_key", "size", "source_size", "target"]
    few = classes.where(F.col("n") <= DEALT).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # A class with very many rows is dealt out by several tasks.
    blocks = classes.where(F.col("n") > DEALT).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / DEALT)))).repartition("doc_id", "text_key", "block")
    first = F.col("block") * DEALT
    many = blocks.withColumn("i", F.explode(F.sequence(first, F.least(first + DEALT, F.col("n")) - 1))).drop("block")
    return few.union(many).select(*columns, _of_row(F.col("i")).alias("copies"))


def mix_counts(docs: DataFrame, seed: int = 11) -> DataFrame:
    return copies(saved(words_of(docs)), seed)


def _numbered_in_class(rows: DataFrame) -> DataFrame:
    """``rows(id, key, source, ...)`` with i, their 0-based number in their class; a class with most rows is spread over the partitions they stand in."""
    by = ["id", "key", "source"]
    placed = saved(rows.withColumn("part", F.spark_partition_id()))
    inside = placed.withColumn("own", F.row_number().over(Window.partitionBy(*by, "part").orderBy(F.lit(0))) - 1)
    counts = placed.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in (*by, "part")], before.alias("before"))
    same = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    return inside.join(starts, same).withColumn("i", F.col("before") + F.col("own"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it."""
    taken = class_copies(saved(words_of(docs)), seed).where("copies > 0")
    taken = saved(taken.select(id_key().alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"), "n", "copies"))
    rows = packed(docs).withColumn("source", F.col("row.source"))
    same = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))
    single = rows.join(taken.where("n = 1"), same).select("row", F.col("copies").cast("int").alias("copies"))
    several = saved(taken.where("n > 1"))  # a table of its own: while it is small, the texts need no second shuffle
    repeated = rows.join(several, same).select("id", "key", "source", "row", "n", "copies")
    dealt = _numbered_in_class(repeated).select("row", _of_row(F.col("i")).alias("copies"))
    return single.union(dealt).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
