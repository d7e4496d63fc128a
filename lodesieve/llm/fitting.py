"""Parts shared by the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows whose labels are never seen; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def training_labels(labels: DataFrame, column: str, modulus: int, remainder: int) -> DataFrame:
    """(label_id, y) of the rows that may be learnt from; repeated labels of one id are averaged, nulls ignored."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    return rows.groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(column).alias("y"))


def summed(df: DataFrame, matrix: Callable[[pd.DataFrame], np.ndarray], n: int) -> np.ndarray:
    """The sum of matrix(rows), n numbers, over all rows: each partition adds up its own, Spark adds the partitions' cells."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        for pdf in frames:
            total += matrix(pdf)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells.astype(np.int32), "value": total[cells]})

    out = np.zeros(n)
    for row in df.mapInPandas(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # n rows at most
        out[row["cell"]] = row["value"]
    return out
