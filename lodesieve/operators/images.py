"""Image blocks inside JSON records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.functions.json_nodes import nodes, parse

# Accepted media types.
MEDIA_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")


def _image_source(node: dict) -> dict | None:
    source = node.get("source")
    if node.get("type") != "image" or not isinstance(source, dict) or source.get("type") != "base64":
        return None
    data = source.get("data")
    return source if isinstance(data, str) and data and source.get("media_type") in MEDIA_TYPES else None


def _blocks(text: str | None) -> list[dict]:
    inside = (v for v, _ in nodes(parse(text), None, lambda note, parent, key: None) if isinstance(v, dict))
    return [{"media_type": s["media_type"], "data": s["data"]} for s in map(_image_source, inside) if s]


def extract_image_blocks(records: DataFrame) -> DataFrame:
    """One row per base64 image block found at any depth of a JSON record.

    Blocks sit at arbitrary depth, which no built-in can walk.  Only records that
    look like JSON and mention both an image and base64 reach the function.
    """
    @F.pandas_udf("array<struct<media_type:string,data:string>>")
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(_blocks)

    text = F.col("text")
    gated = records.where(text.rlike(r"\A\s*+[\[{]") & F.contains(text, F.lit('"image"')) & F.contains(text, F.lit("base64")))
    return (gated.select("source", "file", "line", F.posexplode(blocks(text)).alias("block", "b"))
            .select("source", "file", "line", "block", "b.media_type", F.try_to_binary("b.data", F.lit("base64")).alias("content"))
            .withColumn("n_bytes", F.octet_length("content")))
