"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodesieve.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
_LOCAL_BITS = 33  # of monotonically_increasing_id: the position inside a partition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key() -> Column:
    """Tells rows of one doc_id apart; rows that agree in both are equal and get equal results."""
    return F.xxhash64(F.col("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with its 0-based position in the order ``by``.

    A range partitioning spreads the rows, each partition numbers its own, and one offset per partition shifts them; only
    these offsets, as many as there are partitions, pass through the driver. ``by`` should end in columns that tell rows
    apart, so that no value holds a partition of its own.
    """
    local = (df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
             .withColumn("_local", F.monotonically_increasing_id()))
    local = saved(local)
    part = F.shiftright("_local", _LOCAL_BITS)
    offsets, total = [], 0
    for row in sorted(local.groupBy(part.alias("part")).count().collect()):
        offsets.append((row["part"], total))
        total += row["count"]
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_offset", T.LongType())])
    shifts = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    inside = F.col("_local").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (local.withColumn("_part", part).join(shifts, "_part")
            .withColumn(name, F.col("_offset") + inside).drop("_part", "_offset", "_local"))


def id_key() -> Column:
    """doc_id as a text that is never null: a join by it and a later window share one shuffle."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """(id, key, row): each row as one struct, so that no column of docs can clash with columns of an operator."""
    return docs.select(id_key().alias("id"), text_key().alias("key"), F.struct(*docs.columns).alias("row"))


def attached(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(row, value): each row of docs as a struct, with one value of ``values(doc_id, text_key, value)``.

    Rows that agree in doc_id and text take the values in ascending order, one each. The text moves once, by its key.
    """
    found = values.groupBy(id_key().alias("id"), F.col("text_key").alias("key")).agg(F.sort_array(F.collect_list("value")).alias("values"))
    rows = packed(docs).join(found, ["id", "key"])
    turn = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.size("values")))
    return rows.withColumn("turn", turn).select("row", F.element_at("values", F.col("turn")).alias("value"))


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
