"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest of their id inside each source, ranked there, and sorted by the fractional rank
(rank - 0.5) / n, so each stretch of the order holds all sources in their proportion. Equal cuts of it are the shards: row
counts differ by one at most (the law ``rows``).

Both rankings are range partitioned (``numbered``), so a source with a third of all rows is spread over all tasks. A null
id or source is a value of its own, sorted first. Repeated rows get slots of their own. No rows, no shards. All other
columns travel along; columns named ``_draw``, ``_rank``, ``_share``, ``_first``, ``_n``, ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import attached, numbered, saved, text_key

LAW = "rows"


def shard(df: DataFrame, n_shards: int, key: str = "doc_id", source: str = "source", ties: tuple[str, ...] = (), seed: int = 20) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0). ties: columns that tell rows of one id apart."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = saved(df.drop("shard", "slot").withColumn("_draw", draw))  # range partitioning reads its input twice
    order = ["_draw", key, *ties]
    ranked = numbered(rows, [source, *order], "_rank")
    sources = ranked.groupBy(F.col(source).alias("_source")).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shares = (ranked.join(sources, ranked[source].eqNullSafe(sources["_source"]))
              .withColumn("_share", (F.col("_rank") - F.col("_first") + 0.5) / F.col("_n")).drop("_source", "_first", "_n", "_rank"))
    placed = numbered(shares, ["_share", source, *order], "_at")
    total = placed.count()
    at = F.col("_at")
    number = F.expr(f"cast((_at * {n_shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", number).withColumn("slot", at - first).drop("_draw", "_share", "_at")


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """The rows of docs with shard and slot; columns of these names are replaced. Texts move once, when slots are known."""
    narrow = docs.select("doc_id", "source", text_key().alias("text_key"))
    placed = shard(narrow, n_shards, ties=("text_key",))
    values = placed.select("doc_id", "text_key", F.struct("shard", "slot").alias("value"))
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return attached(docs, values).select(*(F.col(f"row.`{c}`").alias(c) for c in own), "value.shard", "value.slot")
