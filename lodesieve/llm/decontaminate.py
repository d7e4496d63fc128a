"""Benchmark decontamination by an FM-index per shard of the training texts.

A shard is a bounded run of documents of one partition. Its words are numbered by the benchmark's vocabulary; words outside
it share one symbol that no window holds, and stretches that are too short for the shortest window shrink to that symbol
(they cannot hold an occurrence). The shard's suffixes are sorted, its Burrows-Wheeler transform goes into a wavelet tree
(one bit vector with ranks per bit of the symbols), and all windows of the benchmark are searched backwards at once. Rows
of the suffix array are located by walking to the next sampled position; occurrences become spans, which are merged.

A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter item. The benchmark is broadcast in blocks
of at most ``BLOCK_WORDS`` words (or one item), and the documents pass through one search per block. A block's size is bounded;
their number, and with it the broadcasts alive in a task, grows with the benchmark.

Null or empty texts have no words and no windows. A null item_id is listed as an empty string; items with the same id count
once. Repeated rows are each judged. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
BLOCK_WORDS = 1 << 20   # of the benchmark, searched at once
SHARD_WORDS = 1 << 20   # of the documents in one index, or one document
SAMPLE = 8              # every so many positions of a shard is kept for locating

_TO_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Windows:
    """The distinct windows of a block of the benchmark, longest first, as symbols 2, 3, ... of its vocabulary."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], size: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        self.owners: list[set[str]] = []
        found: dict[tuple[int, ...], int] = {}
        for item, words in items:
            line = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words]
            for at in range(max(1, len(line) - size + 1) if line else 0):
                window = tuple(line[at:at + size])
                if found.setdefault(window, len(found)) == len(self.owners):
                    self.owners.append(set())
                self.owners[found[window]].add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.symbols = np.zeros((len(found), size), np.int64)
        for i, window in enumerate(found):
            self.symbols[i, :len(window)] = window
        self.shortest = int(self.lengths.min(initial=size))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling: sort by the first symbol, then by pairs of ranks, until all ranks differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order] = np.concatenate(([0], np.cumsum(np.diff(text[order]) != 0)))
    step = 1
    while ranks.max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - step] = ranks[step:] + 1
        keys = ranks * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        ranks[order] = np.concatenate(([0], np.cumsum(np.diff(keys[order]) != 0)))
        step *= 2
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, by one stable partition for each bit, high bits first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros_before = np.concatenate(([0], np.cumsum(1 - ones)))
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start = np.zeros_like(at)
        for bit, zeros_before, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            at = np.where(one, zeros + at - zeros_before[at], zeros_before[at])
            start = np.where(one, zeros + start - zeros_before[start], zeros_before[start])
        return at - start


class FMIndex:
    """Over symbols above 0; 0 is put at the end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        bits = max(1, int(text.max()).bit_length())
        self.tree = WaveletTree(self.bwt, bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        self.sampled = order % sample == 0
        self.sampled_before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]
        self.most = int(text.max())

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes begin with each pattern (rows of symbols), read from its end."""
        low = np.zeros(len(lengths), np.int64)
        high = np.full(len(lengths), len(self.bwt), np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > k) & (high > low))
            if not len(live):
                break
            c = symbols[live, lengths[live] - 1 - k]
            known = c <= self.most
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, by steps to the symbol before until a sampled position is met."""
        out, steps, open_ = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at]
            out[open_[hit]] = self.samples[self.sampled_before[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            c = self.bwt[at]
            rows[open_] = self.before[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return out


def search_shard(docs: list[list[bytes]], windows: Windows) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document the merged spans (start, stop) of words under an occurrence, and the items that occur."""
    get, least = windows.symbol.get, windows.shortest
    pieces, places, owner, size = [], [], [], 0
    for i, words in enumerate(docs):
        line = np.array([get(w, 1) for w in words], np.int64)
        known = np.concatenate(([0], (line > 1).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        for start, stop in zip(edges[::2], edges[1::2], strict=True):
            if stop - start >= least:
                pieces += [line[start:stop], [1]]
                places.append((size, int(start)))
                owner.append(i)
                size += stop - start + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    if not pieces or not len(windows.lengths):
        return list(zip(spans, items, strict=True))
    index = FMIndex(np.concatenate(pieces))
    low, high = index.search(windows.symbols, windows.lengths)
    counts = high - low
    begins = np.array([x for x, _ in places])
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    which = np.flatnonzero(counts > 0)
    groups = np.split(which, np.searchsorted(np.cumsum(counts[which]), np.arange(1 << 20, int(counts.sum()), 1 << 20)))
    for part in groups:
        n = counts[part]
        rows = np.repeat(low[part], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        window = np.repeat(part, n)
        at = index.locate(rows)
        stretch = np.searchsorted(begins, at, side="right") - 1
        hits.append((stretch, at - begins[stretch], window))
    stretch, offset, window = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((offset, stretch))
    for s, o, w in zip(stretch[order].tolist(), offset[order].tolist(), window[order].tolist(), strict=True):
        i = owner[s]
        start = places[s][1] + o
        stop = start + int(windows.lengths[w])
        items[i] |= windows.owners[w]
        if spans[i] and spans[i][-1][1] >= start:
            spans[i][-1] = (spans[i][-1][0], max(stop, spans[i][-1][1]))
        else:
            spans[i].append((start, stop))
    return list(zip(spans, items, strict=True))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size; the driver holds two blocks at a time."""
    block, held = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        words = words_of(row["text"])
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row["item"], words))
        held += len(words)
    yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, leak_spans (word positions [start, stop) in order) and leak_items (item ids as strings, sorted).

    Without keep_text the last search drops the texts.
    """
    names = [c for c in docs.columns if c not in ("n_words", "leak_spans", "leak_items")]
    rows = docs.select(*names, F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("leak_spans"), F.array().cast("array<string>").alias("leak_items"))
    schema = rows.schema

    def searcher(shared, out):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, window)
            held, words, size = [], [], 0
            for batch in batches:
                at = 0
                for i, text in enumerate(batch.column("text")):
                    words.append(words_of(text.as_py()))
                    size += len(words[-1])
                    if size >= shard_words:
                        held.append(batch.slice(at, i + 1 - at))
                        yield from flush(held, words, windows)
                        held, words, size, at = [], [], 0, i + 1
                if at < batch.num_rows:
                    held.append(batch.slice(at))
            if held:
                yield from flush(held, words, windows)

        def flush(held, words, windows):
            found, k = search_shard(words, windows), 0
            for batch in held:
                part = found[k:k + batch.num_rows]
                old = zip(batch.column("leak_spans").to_pylist(), batch.column("leak_items").to_pylist(), part, strict=True)
                both = [(_merged([*map(tuple, a), *x[0]]), sorted({*b, *x[1]})) for a, b, x in old]
                made = {"n_words": pa.array([len(w) for w in words[k:k + batch.num_rows]], pa.int64()),
                        "leak_spans": pa.array([x[0] for x in both], pa.list_(pa.list_(pa.int32()))), "leak_items": pa.array([x[1] for x in both], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in out], names=out)
                k += batch.num_rows

        return run

    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        out = schema if after is not None or keep_text else T.StructType([f for f in schema if f.name != "text"])
        rows = rows.mapInArrow(searcher(context.broadcast(block), out.names), out)
        block = after
    return rows


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window occurs."""
    others = [c for c in docs.columns if c != "text"]
    found = find_leaks(docs.select("text", F.struct(*others).alias("others")), benchmark).where(F.size("leak_spans") == 0)
    return found.select(*(F.col(c if c == "text" else f"others.`{c}`").alias(c) for c in docs.columns))


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark, keep_text=False)
    hit = F.aggregate("leak_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("leak_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("leak_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
