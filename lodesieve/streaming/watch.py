"""Watching a growing set of records with Structured Streaming.

The stream runs the same column expressions as a batch.  Two things need state:

* seams: the open end of a record waits for its neighbour, which may arrive in any
  later micro-batch (a map of open ends per block of lines);
* alerts: the first sighting of a (rule, preview) is a ``finding``, later ones are
  ``reexposure`` with a running count (a keyed count with a time to live).  Previews
  of many values coincide; findings made ``by_value`` are counted by (rule, value hash).

Counts run in the order of arrival; ``by_place`` numbers delivered events by place.

An end leaves the state as soon as its neighbour comes, so a file that was read in
full keeps one short window.  Both take a time to live.  Set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from lodesieve.catalog.rules import DEFAULT_RULES, Rule
from lodesieve.operators.boundary import BLOCK_LINES, in_blocks, straddling, windowed
from lodesieve.operators.extract import explode_hits
from lodesieve.operators.rollup import reexposure_counts, suppress_known
from lodesieve.plans.scan import ScanOptions, classify, expanded_matches, findings_of, record_gate, record_hits

RECORD_SCHEMA = "source string, file string, line int, text string, mtime_ms bigint, size_bytes bigint"


def read_record_stream(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """Records that arrive as parquet files; the limits bound one micro-batch."""
    reader = spark.readStream.schema(RECORD_SCHEMA).format("parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path).withColumn("arrived", F.col("_metadata.file_modification_time"))


def read_file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Whole files that arrive under ``path``: ``source, file, content, arrived``.

    Each delivery is a folder, ``path/<delivery>/<source>/<file>/<part>``, because a stream
    takes a path once: a rewritten file comes in a new delivery under its old name.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    at = F.split("path", "/")
    return reader.schema(schema).load(path).select(
        F.element_at(at, -3).alias("source"), F.element_at(at, -2).alias("file"), F.col("content").cast("string").alias("content"),
        F.col("modificationTime").alias("arrived"))


def new_versions(files: DataFrame, delay: str = "30 days") -> DataFrame:
    """Rewritten files, once per content: a new time with the same bytes is no news.

    ``files`` is a stream of ``source, file, content, arrived``; remembered hashes
    are dropped after ``delay``.
    """
    return (files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
            .withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["source", "file", "content_hash"]))


class _SeamProcessor(StatefulProcessor):
    """Pairs the lines of one block of a file, whenever and in whatever order they arrive.

    ``tails`` and ``heads`` hold the open ends by line.  Lines that come together are paired
    at once; only what is left over touches the state.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        limits = {} if self._ttl_ms is None else {"ttlDurationMs": self._ttl_ms}
        self._tails = handle.getMapState("tails", "line int", "tail string, mtime_ms bigint", **limits)
        self._heads = handle.getMapState("heads", "line int", "head string", **limits)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        tails: dict[int, tuple[str, int | None]] = {}
        heads: dict[int, str] = {}
        for batch in rows:
            for line, own, tail, head, mtime in zip(batch["line"], batch["own"], batch["tail"], batch["head"], batch["mtime_ms"], strict=True):
                if own:
                    tails[int(line)] = (tail, None if pd.isna(mtime) else int(mtime))
                if not own or line % BLOCK_LINES:  # the first line of a block ends the block before
                    heads[int(line)] = head
        found = [(line, *tails.pop(line), heads.pop(line + 1)) for line in sorted(tails) if line + 1 in heads]
        for line, (tail, mtime) in tails.items():
            if self._heads.containsKey((line + 1,)):
                found.append((line, tail, mtime, self._heads.getValue((line + 1,))[0]))
                self._heads.removeKey((line + 1,))
            else:
                self._tails.updateValue((line,), (tail, mtime))
        for line, head in heads.items():
            if self._tails.containsKey((line - 1,)):
                tail, mtime = self._tails.getValue((line - 1,))
                found.append((line - 1, tail, mtime, head))
                self._tails.removeKey((line - 1,))
            elif line > 1:
                self._heads.updateValue((line,), (head,))
        rows = [(*key[:2], line, mtime, tail, head) for line, tail, mtime, head in found]
        yield pd.DataFrame(rows, columns=["source", "file", "line", "mtime_ms", "tail", "head"], dtype=object)

    def close(self) -> None:
        pass


def stream_seams(records: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, ttl_ms: int | None = None) -> DataFrame:
    """Seams of a stream of records, each exactly once, however far apart the two records arrive.

    State is keyed by (source, file, block of lines), so one huge file is spread; it holds
    only windows whose neighbour has not come yet.  Nothing is given up unless ``ttl_ms``
    is set, which needs a query that runs on.
    """
    rows = in_blocks(windowed(records, rules).select("source", "file", "line", "mtime_ms", "tail", "head"))
    # Where a row stands at the end of the block before its own, only its head counts.
    rows = rows.withColumn("own", F.col("block") == F.floor(F.col("line") / BLOCK_LINES))
    return rows.groupBy("source", "file", "block").transformWithStateInPandas(
        statefulProcessor=_SeamProcessor(ttl_ms), outputStructType="source string, file string, line int, mtime_ms bigint, tail string, head string",
        outputMode="append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def stream_findings(records: DataFrame, options: ScanOptions = ScanOptions(), seam_ttl_ms: int | None = None, by_value: bool = False) -> DataFrame:
    """Findings of a stream of records, values split over micro-batches included."""
    text = F.col("text")
    counted = records.observe("records", F.count(F.lit(1)).alias("records"), F.count_if(text.isNull()).alias("failed"))
    inside = explode_hits(counted.where(record_gate(text, options)), record_hits(text, options))
    over = straddling(stream_seams(records, options.secret_rules, seam_ttl_ms), options.secret_rules)
    matches = classify(inside.unionByName(over), options)
    matches = matches.observe("matches", F.count_if(F.col("suppressed_reason").isNotNull()).alias("suppressed"))
    return findings_of(expanded_matches(matches, options.include_suppressed), by_value)


class _SightingProcessor(StatefulProcessor):
    """Counts sightings of one (rule, preview) or (rule, value hash)."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("n", LongType())])
        self._count = (handle.getValueState("count", schema) if self._ttl_ms is None
                       else handle.getValueState("count", schema, ttlDurationMs=self._ttl_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self._count.get()[0] if self._count.exists() else 0
        for batch in rows:
            out = batch.sort_values(["source", "file", "line"], kind="stable").reset_index(drop=True)
            out["nth"] = range(n + 1, n + 1 + len(out))
            out["event"] = ["finding" if k == 1 else "reexposure" for k in out["nth"]]
            n += len(out)
            yield out[["event", "nth", "rule_id", "preview", "label", "confidence", "source", "rel_file", "file", "line", "fingerprint"]]
        self._count.update((n,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802
        # A baseline counts as seen, but says nothing.
        self._count.update((int(initialState["n"].sum()),))

    def close(self) -> None:
        pass


_EVENT_SCHEMA = ("event string, nth bigint, rule_id string, preview string, label string, confidence string, source string, "
                 "rel_file string, file string, line int, fingerprint string")


def _identity(findings: DataFrame) -> list[str]:
    """What sightings are counted by."""
    return ["rule_id", "value_hash" if "value_hash" in findings.columns else "preview"]


def first_seen_or_reexposure(findings: DataFrame, baseline: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Turn a stream of findings into events with a running count per (rule, preview), or (rule, value hash) where there is one.

    ``baseline`` (these two and ``n``) holds what was there before the watch
    started: it never alerts, and its repetitions are re-exposures.  ``ttl_ms``
    forgets what was not seen for that long; it needs a query that runs on, since
    processing time never lets an ``availableNow`` run end.
    """
    by = _identity(findings)
    rows = findings.select(*by, *[c for c in ("preview", "label", "confidence", "source", "rel_file", "file", "line", "fingerprint") if c not in by])
    seen = None if baseline is None else baseline.select(*by, "n").groupBy(*by)
    return rows.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=_SightingProcessor(ttl_ms), outputStructType=_EVENT_SCHEMA, outputMode="append",
        timeMode="None" if ttl_ms is None else "ProcessingTime", initialState=seen)


def first_seen(findings: DataFrame, arrived: str, delay: str = "30 days") -> DataFrame:
    """The light form without counts: the first finding of each (rule, preview)."""
    return findings.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["rule_id", "preview"])


def _published(batch: DataFrame, settled: DataFrame | None, path: str, batch_id: int) -> None:
    """Counts of one micro-batch, as one file of the metrics table; a repeated batch replaces itself."""
    rows = batch.withColumn("settled", F.lit(False)) if settled is None else batch.join(
        settled.select("fingerprint").distinct().withColumn("_known", F.lit(True)), "fingerprint", "left").withColumn("settled", F.col("_known").isNotNull())
    open_ = ~F.col("settled")
    counts = rows.agg(F.count_if(open_ & (F.col("event") == "finding")).alias("loud"), F.count_if(open_ & (F.col("event") == "reexposure")).alias("quiet"),
                      F.count_if("settled").alias("settled"))
    counts.withColumn("batch", F.lit(batch_id).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{path}/id={batch_id}")


def baseline_of(findings: DataFrame) -> DataFrame:
    """Sightings in what exists before a watch starts."""
    return findings.groupBy(*_identity(findings)).agg(F.count("*").alias("n"))


def by_place(events: DataFrame) -> DataFrame:
    """Events of deliveries that are all in, numbered along file and line.

    A running count cannot know that an earlier place comes in a later delivery, so it
    follows the arrival; a report on what has come wants the first place to be the finding.
    """
    return reexposure_counts(events.drop("event", "nth"), ["file", "line"])


def watch(findings: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          load_ledger: Callable[[], DataFrame] | None = None, baseline: DataFrame | None = None,
          once: bool = True, metrics: str | None = None, ttl_ms: int | None = None) -> StreamingQuery:
    """Run a watch: events of new findings go to ``sink(events, batch_id)``.

    The ledger is loaded again for every micro-batch, so an acknowledgement takes
    effect without a restart.  ``once`` handles what has arrived since the last
    call and stops; otherwise the query runs on.  ``ttl_ms`` forgets sightings after
    that time, if the query runs on; nothing is forgotten unless asked.  ``metrics``
    is a folder for one row of counts per micro-batch: new, repeated and settled
    events; see ``stream_metrics``.
    """
    if once and ttl_ms is not None:
        raise ValueError("sightings can only be forgotten by a query that runs on")
    events = first_seen_or_reexposure(findings, baseline, ttl_ms)

    def handle(batch: DataFrame, batch_id: int) -> None:
        settled = None if load_ledger is None else load_ledger()
        batch = batch.persist()
        try:
            sink(batch if settled is None else suppress_known(batch, settled), batch_id)
            if metrics is not None:
                _published(batch, settled, metrics, batch_id)
        finally:
            batch.unpersist()

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


class StreamCounts(StreamingQueryListener):
    """What the stream itself counted per micro-batch: records read, records without a readable text, suppressed matches.

    Register it with ``spark.streams.addListener``; one row of three numbers per batch reaches the driver.
    """

    def __init__(self) -> None:
        self.rows: dict[int, tuple[int, int, int]] = {}
        self._seen = -1

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        observed = event.progress.observedMetrics
        if "records" in observed and "matches" in observed:
            self.rows[event.progress.batchId] = (observed["records"]["records"], observed["records"]["failed"], observed["matches"]["suppressed"])
        self._seen = max(self._seen, event.progress.batchId)

    def wait_for(self, query: StreamingQuery, seconds: float = 30) -> None:
        """Progress is told asynchronously: wait until the last batch of a finished query has been told."""
        last = query.lastProgress
        end = time.monotonic() + seconds
        while last is not None and self._seen < last["batchId"] and time.monotonic() < end:
            time.sleep(0.05)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b, *counts) for b, counts in sorted(self.rows.items())], "batch bigint, records bigint, failed bigint, suppressed bigint")


def stream_metrics(spark: SparkSession, path: str, counts: StreamCounts | None = None) -> DataFrame:
    """Counts of every finished micro-batch of a watch: ``batch, loud, quiet, settled``, with ``records, failed, suppressed`` of a listener."""
    events = spark.read.parquet(f"{path}/id=*").select("batch", "loud", "quiet", "settled")
    return events if counts is None else events.join(counts.table(spark), "batch", "left")
