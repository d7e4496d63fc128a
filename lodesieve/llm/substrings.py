"""Removal of repeated passages by a compacted de Bruijn graph over words.

A window of ``WINDOW`` words is an edge of the graph, from its first to its last ``WINDOW`` - 1 words; an edge that is met twice
is repeated. Edges of a text that share an anchor, the least hash among the ``KMER``-word k-mers of the window, follow each
other without a branch: they are compacted to one path, and only paths are shuffled, about one for 14 words.

1. Equal windows have equal anchors, so a path whose anchor occurs once holds no repeated edge; a join drops these.
2. Equal paths collapse into one content with a count. A content that occurs twice is repeated as a whole.
3. Contents that share an anchor but differ (at the ends of a passage) are opened again: one copy of each is read back at its
   source coordinates, and their edges are joined one by one.
4. The coordinates of repeated edges return to their documents, where they become maximal spans of words.

All hashes have 64 bits, and edges are compared within their anchor, so two windows are taken as equal if 128 bits agree.
Nothing is collected, and hot passages are counted before they are shuffled; documents are keyed by doc_id and text, so
repeated rows repeat each other's windows. A null text has no words. A text below ``WINDOW`` words keeps all of them. Texts of
any length are taken whole. Other columns play no part, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import discard, saved, text_key

WINDOW = 35
KMER = 8           # words of an anchor
MEMO = 400_000     # hashes of words that a worker remembers

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_MEMO = _Memo()
_POWERS = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        more = np.full(max(n, 2 * len(have)), base, np.uint64)
        more[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(more)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    have, size = values, 1
    while 2 * size <= width:
        have, size = np.minimum(have[:-size], have[size:]), 2 * size
    rest = width - size
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


class Text:
    """Hashes of the words of one text."""

    def __init__(self, words: list[bytes]):
        self.h = np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.h * _powers(_BASE, len(words)))))

    def digest(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """A hash of the words [start, start + length), wherever they stand."""
        x = (self.sums[start + length] - self.sums[start]) * _powers(_INVERSE, len(self.sums))[start]
        return _mixed(x + np.asarray(length, np.uint64) * _B)

    def paths(self, window: int = WINDOW, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, windows) of each compacted path; the text has ``window`` words at least."""
        kmers = _mixed(self.digest(np.arange(len(self.h) - kmer + 1), kmer) * _A)
        span = window - kmer + 1
        anchors = least(kmers, span)
        # A window has another anchor than the one before it if its value differs or if that one began there.
        new = np.flatnonzero((anchors[1:] != anchors[:-1]) | (kmers[:len(anchors) - 1] == anchors[:-1])) + 1
        starts = np.concatenate(([0], new))
        return anchors[starts], starts, np.diff(np.concatenate((starts, [len(anchors)])))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _none(kind: type) -> np.ndarray:
    return np.zeros(0, kind)


def paths_of(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    """(doc_id, text_key, anchor, digest, start, n) of each path of each row."""
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts = [], [(_none(np.uint64), _none(np.uint64), _none(np.int64), _none(np.int64))]
            for i, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                if len(words) >= window:
                    hashed = Text(words)
                    anchor, start, n = hashed.paths(window, kmer)
                    row.append(np.full(len(n), i))
                    parts.append((anchor, hashed.digest(start, n + (window - 1)), start, n))
            anchor, digest, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = pa.array(np.concatenate(row) if row else _none(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), _signed(anchor), _signed(digest),
                                              pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                                             names=["doc_id", "text_key", "anchor", "digest", "start", "n"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, anchor bigint, digest bigint, start int, n int")


def _edges(docs: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, start, anchor, edge, copies): each window of the opened contents, read at its source."""
    lists = opened.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("anchor", "start", "n", "copies")).alias("open"))
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    rows = (texts.join(lists, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_key"] == F.col("_key")))
            .select("doc_id", "text_key", "text", F.col("open.anchor").alias("anchor"), F.col("open.start").alias("start"), F.col("open.n").alias("n"), F.col("open.copies").alias("copies")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts = [], [(_none(np.int64), _none(np.int64), _none(np.uint64), _none(np.int64))]
            for i, (text, *lists) in enumerate(zip(*(batch.column(c) for c in ("text", "anchor", "start", "n", "copies")), strict=True)):
                anchor, start, n, copies = (np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in lists)
                at = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row.append(np.full(len(at), i))
                parts.append((np.repeat(anchor, n), at, Text(words_of(text.as_py())).digest(at, window), np.repeat(copies, n)))
            anchor, at, edge, copies = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = pa.array(np.concatenate(row) if row else _none(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array(at.astype(np.int32)), pa.array(anchor), _signed(edge), pa.array(copies)],
                                             names=["doc_id", "text_key", "start", "anchor", "edge", "copies"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, start int, anchor bigint, edge bigint, copies bigint")


def repeated_windows(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, text_key, start, n): n windows from the word start on are repeated."""
    every = saved(paths_of(docs, window, kmer))
    # Key tables are saved before they are joined: only joins of two plain shuffles are split where a key is hot.
    twice = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").select("anchor"))
    paths = saved(every.join(twice, "anchor", "left_semi"))
    discard(every, twice)
    source = F.struct("start", "doc_id", "text_key")
    contents = saved(paths.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min(source).alias("at")))
    whole = paths.join(contents.where("copies > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    ways = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("ways"), F.min("copies").alias("least"))
    branching = saved(ways.where("ways > 1 and least = 1").select("anchor"))
    opened = contents.join(branching, "anchor", "left_semi").select("anchor", "n", "copies", "at.start", "at.doc_id", "at.text_key")
    edges = saved(_edges(docs, opened, window))
    discard(branching)
    again = saved(edges.groupBy("anchor", "edge").agg(F.sum("copies").alias("total")).where("total > 1").select("anchor", "edge"))
    single = edges.where("copies = 1").join(again, ["anchor", "edge"], "left_semi")
    columns = ["doc_id", "text_key", "start"]
    spans = saved(whole.select(*columns, "n").union(single.select(*columns, F.lit(1).alias("n"))))
    discard(paths, contents, edges, again)
    return spans


def covered(n_words: int, starts: list[int], counts: list[int], window: int = WINDOW) -> np.ndarray:
    """Which words lie under a repeated window."""
    turn = np.zeros(n_words + 1, np.int64)
    first = np.asarray(starts, np.int64)
    np.add.at(turn, first, 1)
    np.add.at(turn, first + np.asarray(counts, np.int64) + window - 1, -1)
    return np.cumsum(turn[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept are the words left, joined by one space."""
    spans = repeated_windows(docs, window, kmer)
    # Repeated rows report the same spans, which are kept once.
    lists = (spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
             .select("_id", "_key", F.col("spans.start").alias("starts"), F.col("spans.n").alias("counts")))
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    rows = (texts.join(lists, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_key"] == F.col("_key")), "left").select("doc_id", "text", "starts", "counts"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts, counts in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                totals.append(len(words))
                if starts.is_valid:
                    gone = covered(len(words), starts.as_py(), counts.as_py(), window)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
