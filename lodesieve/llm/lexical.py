"""Ranked lexical search, reversed: the items' terms are indexed, and the documents stream through the index.

The items (the queries) are taken in blocks of at most ``BLOCK_POSTINGS`` different terms of items (or one item). A block's
inverted index, from a term to the items that hold it, is broadcast. One pass over whole texts keeps of each document its
length and how often the block's terms occur in it, as a narrow table, which gives the corpus counts and each term's number
of documents. A second pass over that table adds up the scores of all items a document shares a term with, and each task
keeps a heap of the best documents per item, ``top`` rows an item; the tasks' heaps are merged by a limited ranking. Nothing
but these heaps and one count per term of the block leaves the tasks, and the block's index goes before the next one comes.

A document's score for an item sums ``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` over the item's terms, repeats included:
w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 25 + (75 * n * N) div L; N documents with a term, L their terms, n the
document's, df documents holding the term, tf its occurrences in the document. Sums are exact integers.

Terms are runs of 0-9, a-z and non-ASCII characters, A-Z in lower case. Null, empty and blank texts have none: such
documents are not counted, such items get no rows. Each row of docs is a document and each row of items an item, repeated
ones and null ids included (null ids come last among equal scores). doc_id is an integer. Other columns play no part.
Texts of any length are taken whole. No documents, or no items: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesieve.llm.common import discard, saved

TOP = 10
BLOCK_POSTINGS = 1 << 20   # different terms of items in one index
_CELLS = 1 << 21           # scores added up at once
_EXACT = 1 << 53           # integers below are exact as doubles
_HELD = 1 << 16            # candidates held before they are merged into the heaps
_NO_ID = (1 << 63) - 1

_TO_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TO_TERMS).split()


class Index:
    """A block of items as an inverted index: postings of term t are items[starts[t]:starts[t + 1]], with their repeats."""

    def __init__(self, block: list[Counter]):
        self.term: dict[bytes, int] = {}
        self.size = len(block)
        made = sorted((self.term.setdefault(w, len(self.term)), i, n) for i, item in enumerate(block) for w, n in item.items())
        of, items, times = np.array(made, np.int64).reshape(-1, 3).T
        self.items, self.times = items.copy(), times.copy()
        self.starts = np.searchsorted(of, np.arange(len(self.term) + 1))
        self.most = int(np.bincount(items, times, self.size).max(initial=0))  # terms of one item

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, score) of all pairs that share a term; part is what a term adds for one occurrence in an item."""
        n = self.starts[term + 1] - self.starts[term]
        of = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(of)) + np.repeat(self.starts[term] - (np.cumsum(n) - n), n)
        cell = doc[of] * self.size + self.items[at]
        value = part[of] * self.times[at]
        cells = docs * self.size
        if cells > 4 * len(cell):
            touched, cell = np.unique(cell, return_inverse=True)
        else:
            touched = np.arange(cells)
        if int(part.max(initial=0)) * self.most < _EXACT:
            total = np.bincount(cell, value, len(touched)).astype(np.int64)
        else:
            total = np.zeros(len(touched), np.int64)
            np.add.at(total, cell, value)
        some = total > 0
        return touched[some] // self.size, touched[some] % self.size, total[some]


class Heaps:
    """The best documents of each item so far, at most ``top`` an item."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)  # a score below it is out
        self.rows = np.zeros((4, 0), np.int64)  # item, score, id is null, id
        self.held: list[np.ndarray] = []

    def offer(self, item: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[item]
        self.held.append(np.array([item[good], score[good], none[good], ids[good]], np.int64))
        if sum(x.shape[1] for x in self.held) > _HELD:
            self.merge()

    def merge(self) -> None:
        rows = np.concatenate((self.rows, *self.held), axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        n = np.bincount(rows[0], minlength=len(self.least))
        first = np.cumsum(n) - n
        self.rows, self.held = rows[:, np.arange(rows.shape[1]) - first[rows[0]] < self.top], []
        full = np.flatnonzero(n >= self.top)
        self.least[full] = rows[1, first[full] + self.top - 1]


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[Counter]]]:
    """The items with terms, in blocks; the driver holds one block and one partition of items at a time."""
    ids, block, size = [], [], 0
    for row in items.select("item_id", F.col("text").cast("binary").alias("raw")).toLocalIterator():
        terms = Counter(terms_of(row["raw"]))
        if not terms:
            continue
        if block and size + len(terms) > BLOCK_POSTINGS:
            yield ids, block
            ids, block, size = [], [], 0
        ids.append(row["item_id"])
        block.append(terms)
        size += len(terms)
    if block:
        yield ids, block


def _counted(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, n, terms, times) of the documents with a term: n terms in all, and the indexed ones with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        for batch in batches:
            at, sizes, found, times, ends = [], [], [], [], [0]
            for i, raw in enumerate(batch.column(1)):
                words = terms_of(raw.as_py())
                if not words:
                    continue
                some = [(number[w], n) for w, n in Counter(words).items() if w in number]
                at.append(i)
                sizes.append(len(words))
                found += [t for t, _ in some]
                times += [n for _, n in some]
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def _best(counted: DataFrame, shared, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, score, doc_id): each task's heaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        heaps = Heaps(index.size, top)
        load = np.diff(index.starts)
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            scale = np.array([8 * (25 + 75 * n * n_docs // n_terms) for n in batch.column(1).to_pylist()], np.int64)
            terms, times = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            n = np.array(batch.column(2).value_lengths().to_pylist(), np.int64)
            ends = np.cumsum(n)
            doc = np.repeat(np.arange(len(n)), n)
            part = weights[terms] * (10**9 * times // (1000 * times + scale[doc]))
            cost = np.concatenate(([0], np.cumsum(load[terms])))[np.concatenate(([0], ends))]
            first = 0
            while first < len(n):  # as many documents as touch _CELLS scores, or one
                last = max(first + 1, int(np.searchsorted(cost, cost[first] + _CELLS, "right")) - 1)
                some = slice(ends[first] - n[first], ends[last - 1])
                at, item, score = index.scores(doc[some] - first, terms[some], part[some], last - first)
                heaps.offer(item, score, none[first + at], ids[first + at])
                first = last
        heaps.merge()
        item, score, none, ids = heaps.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=none.astype(bool))], names=["item", "score", "doc_id"])

    return counted.mapInArrow(run, "item bigint, score bigint, doc_id bigint")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its ``top`` documents of highest score above 0, rank from 1."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    done, corpus = [], None
    for ids, block in _blocks(items):
        index = Index(block)
        terms = spark.sparkContext.broadcast(index.term)
        counted = saved(_counted(docs, terms))
        terms.destroy()
        if corpus is None:
            corpus = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = np.zeros(len(index.term), np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row per term of the block
            holders[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * int(df) + 1))) for df in holders], np.int64)
        index.term = {}
        shared = spark.sparkContext.broadcast((index, weights))
        best = _best(counted, shared, corpus[0], max(1, corpus[1]), top).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {kind}")  # of one block
        done.append(saved(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
        shared.destroy()
        discard(counted)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for part in done:
        out = out.union(part)
    return out
