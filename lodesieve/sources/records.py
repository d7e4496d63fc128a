"""Ingestion: everything becomes one ``records`` table.

    source STRING, file STRING, line INT, text STRING, mtime_ms BIGINT, size_bytes BIGINT
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lodesieve.catalog.sources import SOURCES
from lodesieve.functions.text import split_lines, without_line_end

RECORD_COLUMNS = ("source", "file", "line", "text", "mtime_ms", "size_bytes")


def lines_of(text: Column) -> Column:
    """Array of the lines of a text; a final line end does not open another line."""
    return F.when(F.length(text) > 0, split_lines(without_line_end(text))).otherwise(F.array().cast("array<string>"))


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Whole texts (``source, file, mtime_ms, size_bytes`` and the text) to records; blank lines keep their number."""
    return (df.select("source", "file", "mtime_ms", "size_bytes", F.posexplode(lines_of(F.col(text))).alias("i", "text"))
            .select("source", "file", (F.col("i") + 1).alias("line"), "text", "mtime_ms", "size_bytes"))


def as_files(df: DataFrame, file: str, text: str, source: str | Column, mtime_ms: Column | None = None) -> DataFrame:
    """A table with one text per row, seen as a set of files."""
    return df.select(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        F.col(file).cast("string").alias("file"),
        F.col(text).alias("text"),
        (F.lit(0) if mtime_ms is None else mtime_ms).cast("bigint").alias("mtime_ms"),
        F.octet_length(text).cast("bigint").alias("size_bytes"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small table enough partitions for every core; leave a large one alone.

    A text scan is bound by the processor, and a table of a few files or row groups
    would keep most cores idle.  Only tables with fewer partitions than two per
    core are moved, so the shuffle is small by construction.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def document_records(documents: DataFrame) -> DataFrame:
    """Records of a ``documents`` table: one file per document."""
    return explode_lines(as_files(documents, "doc_id", "text", F.col("source")))


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Records of a ``conversations`` table: one record per turn."""
    return conversations.select(
        F.lit("conversations").alias("source"), F.col("conv_id").cast("string").alias("file"),
        (F.col("turn") + 1).cast("int").alias("line"), "text", F.lit(0).cast("bigint").alias("mtime_ms"),
        F.octet_length("text").cast("bigint").alias("size_bytes"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records of a ``pages`` table: the lines of the markup."""
    return explode_lines(as_files(pages, "page_id", "html", "pages"))


def _file_columns() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"),
            F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
            F.col("_metadata.file_size").alias("size_bytes")]


def read_lines(spark: SparkSession, paths: str | list[str], source: str, whole_files: bool = False) -> DataFrame:
    """Text or JSON-lines files as records with exact line numbers.

    A file is read in splits and numbered from the line counts of the splits
    before: one small aggregate per (file, split), no window over a file, and no row
    larger than a line.  With ``whole_files``, for many small files, a file is one
    row that is split in place, without a shuffle.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if whole_files:
        whole = reader.text(paths, wholetext=True).select(F.lit(source).alias("source"), *_file_columns(), F.col("value").alias("text"))
        return explode_lines(whole)
    rows = reader.text(paths).select(
        F.lit(source).alias("source"), *_file_columns(), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    # Ids are consecutive inside a split, so the smallest one numbers the rest.
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first_id", F.coalesce(earlier, F.lit(0)).alias("offset"))
    return (rows.join(starts, ["file", "block"])
            .select("source", "file", (F.col("id") - F.col("first_id") + F.col("offset") + 1).cast("int").alias("line"),
                    "text", "mtime_ms", "size_bytes"))


def read_marked_lines(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """Text files as records whose ``line`` is a mark: consecutive inside a split, numbered later.

    Nothing is joined and no line moves.  What is found keeps its mark, and
    ``with_line_numbers`` turns marks into numbers for these few rows alone.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.text(paths).select(
        F.lit(source).alias("source"), *_file_columns(), F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


_PART_BITS = 33  # of a mark: the position inside a partition


def split_starts(marked: DataFrame) -> DataFrame:
    """``(file, part, first, last, before, first_text, last_text)`` of each split: one small row per split.

    ``before`` is the number of lines of the file in earlier splits.  A partition holds one
    split of a file at most: all but the last one fill a partition.
    """
    splits = marked.groupBy("source", "file", "mtime_ms", F.shiftright("line", _PART_BITS).alias("part")).agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n"),
        F.min_by("text", "line").alias("first_text"), F.max_by("text", "line").alias("last_text"), F.min("split_start").alias("split_start"))
    earlier = F.sum("n").over(W.partitionBy("source", "file").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1))
    return splits.withColumn("before", F.coalesce(earlier, F.lit(0)))


def with_line_numbers(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Marks of ``rows`` to line numbers, by an equi-join with the splits' small table."""
    starts = splits.select(F.col("file").alias("_file"), F.col("part").alias("_part"), (F.col("before") - F.col("first") + 1).alias("_shift"))
    same = (F.col("file") == F.col("_file")) & (F.shiftright("line", _PART_BITS) == F.col("_part"))
    return rows.join(starts, same).withColumn("line", (F.col("line") + F.col("_shift")).cast("int")).drop("_file", "_part", "_shift")


def explode_json_documents(df: DataFrame, col: str = "text", items: str = "history") -> DataFrame:
    """Whole-file JSON sessions to records: the document without its items first, then one record per item.

    A top-level array gives one record per element, anything without an item
    array one record, and text that is not JSON is kept as it is.  Objects are
    written in key order.
    """
    parsed = F.try_parse_json(F.col(col))
    kind = F.schema_of_variant(parsed)
    as_map = F.try_variant_get(parsed, "$", "map<string,variant>")
    rest = F.to_json(F.map_filter(as_map, lambda k, v: k != items))
    elements = F.transform(F.try_variant_get(parsed, f"$.{items}", "array<variant>"), lambda v: F.to_json(v))
    top = F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: F.to_json(v))
    texts = (F.when(parsed.isNull(), F.array(F.col(col)))
             .when(kind.startswith("ARRAY"), top)
             .when(kind.startswith("OBJECT") & elements.isNotNull(), F.concat(F.array(rest), elements))
             .otherwise(F.array(F.to_json(parsed))))
    return (df.select("source", "file", "mtime_ms", "size_bytes", F.posexplode(texts).alias("i", "text"))
            .select("source", "file", (F.col("i") + 1).alias("line"), "text", "mtime_ms", "size_bytes"))


# A whole string, an opening or a closing brace; brackets inside strings are thus never seen.
_JSON_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.DOTALL)


def _complete_objects(text: str) -> list[str]:
    found, opened = [], []
    for mark in _JSON_MARKS.finditer(text):
        if mark[0] == "{":
            opened.append(mark.start())
        elif mark[0] == "}" and opened:
            start = opened.pop()
            if not opened:
                found.append(text[start:mark.end()])
    return found


def salvage_json_objects(df: DataFrame, col: str = "text") -> DataFrame:
    """The complete top-level objects of a possibly truncated JSON array, byte for byte.

    Brackets inside strings must not count, which no built-in expresses, so this
    is a small vectorised function; a file costs one pass over its characters.
    Texts without a closing brace hold no object and never reach it.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def objects(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _complete_objects(t) if t is not None else [])

    return (df.where(F.contains(F.col(col), F.lit("}"))).withColumn("_objects", objects(F.col(col)))
            .select("source", "file", "mtime_ms", "size_bytes", F.posexplode("_objects").alias("i", "text"))
            .select("source", "file", (F.col("i") + 1).alias("line"), "text", "mtime_ms", "size_bytes"))


def table_to_records(df: DataFrame, source: str, key_cols: list[str], as_json: bool = False) -> DataFrame:
    """Rows of a table as records.

    Text values are taken as they are, binary values as UTF-8, other types are
    skipped.  ``as_json`` writes each row as one JSON object instead.  The file
    name is built from ``key_cols``; ``line`` counts the values of a row.
    """
    file = F.concat_ws("/", *[F.col(k).cast("string") for k in key_cols])
    if as_json:
        texts = F.array(F.to_json(F.struct("*")))
    else:
        values = []
        for f in df.schema.fields:
            if f.name in key_cols:
                continue
            if isinstance(f.dataType, T.StringType):
                values.append(F.col(f.name))
            elif isinstance(f.dataType, T.BinaryType):
                values.append(F.make_valid_utf8(F.col(f.name).cast("string")))
        texts = F.filter(F.array(*values), lambda v: F.length(v) > 0) if values else F.array().cast("array<string>")
    return (df.select(file.alias("file"), F.posexplode(texts).alias("i", "text"))
            .select(F.lit(source).alias("source"), "file", (F.col("i") + 1).alias("line"), "text",
                    F.lit(0).cast("bigint").alias("mtime_ms"), F.octet_length("text").cast("bigint").alias("size_bytes")))


def binary_as_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Opaque bytes as one Latin-1 record, so that ASCII tokens inside still match."""
    return df.select("source", "file", F.lit(1).alias("line"), F.decode(F.col(content), "ISO-8859-1").alias("text"),
                     "mtime_ms", F.octet_length(content).cast("bigint").alias("size_bytes"))


def read_binary_as_text(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """Binary session files, one record each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return binary_as_text(files.select(F.lit(source).alias("source"), F.col("path").alias("file"),
                                       F.unix_millis("modificationTime").alias("mtime_ms"), "content"))


def decode_base64_lines(records: DataFrame, header: str) -> DataFrame:
    """Files of base64 lines: the header line and blank lines go, the rest is decoded in place."""
    keep = (F.length("text") > 0) & ~((F.col("line") == 1) & (F.col("text") == header))
    plain = F.make_valid_utf8(F.try_to_binary(F.col("text"), F.lit("base64")).cast("string"))
    return records.where(keep).withColumn("text", plain).where(F.col("text").isNotNull())


def list_files(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """Listing of files without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.lit(source).alias("source"), F.col("path").alias("file"), F.col("length").alias("size_bytes"),
                        F.unix_millis("modificationTime").alias("mtime_ms"), F.lit(False).alias("broken"))


# Which files of a repository checkout are worth a scan.
SKIPPED_DIRS = ("node_modules", ".git")


def select_project_artifacts(listing: DataFrame, path: str = "path") -> DataFrame:
    """Committed agent logs, configurations and root ``.env`` files, by relative path alone."""
    segs = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    n = F.size(segs)
    name = F.element_at(segs, -1)
    parent = F.get(segs, n - 2)
    dirs = F.slice(segs, F.lit(1), n - 1)
    # ".cursor" directly followed by "rules" somewhere above the file
    in_cursor_rules = F.concat(F.lit("/"), F.array_join(dirs, "/"), F.lit("/")).contains("/.cursor/rules/")
    is_log = name.endswith(".jsonl") & (
        F.array_contains(dirs, ".claude") | F.coalesce(parent.startswith("-"), F.lit(False)) | name.startswith("rollout-"))
    is_config = (
        ((parent == ".claude") & name.rlike(r"\Asettings.*\.json\z"))
        | name.isin(".mcp.json", ".cursorrules", "CLAUDE.md", "CLAUDE.local.md", "AGENTS.md")
        | ((parent == ".gemini") & (name == "settings.json"))
        | ((parent == ".vscode") & (name == "tasks.json")))
    is_env = (n == 1) & name.rlike(r"\A\.env(?:\..+)?\z")
    skipped = F.exists(dirs, lambda s: s.isin(*SKIPPED_DIRS))
    wanted = is_log | F.array_contains(dirs, ".specstory") | F.coalesce(is_config, F.lit(False)) | in_cursor_rules | is_env
    return listing.where(wanted & ~skipped)


def coverage_report(listing: DataFrame, records: DataFrame, errors: DataFrame | None = None,
                    max_bytes: int | None = None) -> DataFrame:
    """What happened to every listed file: complete, partial, failed or too large, and whether lines of it could not be matched.

    A line without text, or with text that is not valid UTF-8, cannot be matched; the rest
    of its file is scanned, and the file is named once.

    ``errors`` names files whose reading stopped early.  ``max_bytes`` is the size
    above which the caller left files out; one that was read all the same counts as read.  Lines are counted per
    file with a map-side partial aggregate, so a huge file costs one row per task.
    """
    read = records.groupBy("source", "file").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"),
        F.count_if(F.col("text").isNull() | ~F.is_valid_utf8("text")).alias("unmatched"))
    df = listing.join(read, ["source", "file"], "left")
    if errors is None:
        failed = F.lit(False)
    else:
        df = df.join(errors.select("source", "file").distinct().withColumn("_failed", F.lit(True)), ["source", "file"], "left")
        failed = F.col("_failed").isNotNull()
    lines = F.coalesce("lines", F.lit(0))
    left_out = F.lit(False) if max_bytes is None else (F.col("size_bytes") > max_bytes) & (lines == 0)
    status = (F.when(F.col("broken"), "failed").when(left_out, "too-large")
              .when(failed & (lines > 0), "partial").when(failed, "failed").otherwise("complete"))
    # The reasons are part of the result.
    reason = (F.when(F.col("broken"), "could not be resolved").when(left_out, "too large to scan")
              .when(failed & (lines > 0), "only partially read").when(failed, "could not be read")
              .when(F.col("unmatched") > 0, "some lines could not be matched"))
    return df.select("source", "file", status.alias("status"), reason.alias("reason"),
                     lines.cast("bigint").alias("lines"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
                     F.coalesce("unmatched", F.lit(0)).cast("bigint").alias("unmatched"))


def sources_scanned(coverage: DataFrame) -> DataFrame:
    """Sources with at least one file that could be read."""
    return coverage.where(F.col("status").isin("complete", "partial")).select("source").distinct()


def source_registry(spark: SparkSession) -> DataFrame:
    """The registered sources and how each is read."""
    return spark.createDataFrame(SOURCES, "source_id string, label string, reader string")
