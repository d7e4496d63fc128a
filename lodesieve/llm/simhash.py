"""SimHash near-dedup by a self-join of a binary trie of fingerprints.

Words are runs of non-blanks after A-Z are lower-cased; 3-word shingles vote with the bits of their XXH64 (seed 42). Equal
fingerprints are one leaf of the trie. Pairs of nodes are traversed together from the root: the differing bits of the two
paths add up, and a pair whose sum exceeds the budget is pruned with all that is below it.

Spark deals out the nodes at a depth that grows with the number of fingerprints: a node's fingerprints stay, and visit
those of the nodes above it that the budget allows; each task walks down from its node and from its visitors' root. A node with more fingerprints than a task should hold is dealt out in parts, all of which meet. A task returns a
spanning forest of the links that it finds, never all pairs; components of the forest's edges are those of the links.

Null and empty texts, and texts of blanks, have fingerprint zero and link like any other. Fewer than three words: one
shingle of them all. Repeated rows share their component. component_id is the least doc_id, nulls aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesieve.llm.common import id_key, packed, saved, text_key
from lodesieve.llm.components import components

SHINGLE = 3
SEED = 42
BUDGET = 2
NODE = 1 << 16     # fingerprints of a node that a task walks, on average and at most in one part
DEPTHS = 4, 16     # of the nodes that are dealt out, at least and at most
_DIRECT = 48       # pairs below this many are compared without further descent
_BLOCK = 1 << 19   # node pairs held at once
_VOTES = 1 << 16   # shingles counted at once


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[size - 1:] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _VOTES):
        pairs = zip(starts[at:at + _VOTES][:n - at].tolist(), stops[at:at + _VOTES].tolist(), strict=False)
        votes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64)
        ones += np.unpackbits(votes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, fp bigint")


class _Forest:
    """Union of links by vectorised hooking to the smaller root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def walk(a: np.ndarray, b: np.ndarray, same: bool, budget: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Calls found(i, j) with positions in the sorted arrays a and b whose values differ in at most budget bits.

    same: b is a, and each pair is found once.
    """
    tops = [(63, *(np.array([x]) for x in (0, len(a), 0, len(b), 0)))]
    ones: dict[tuple[int, int], np.ndarray] = {}

    def middle(which: int, values: np.ndarray, bit: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if (which, bit) not in ones:
            ones[which, bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)))).astype(np.int32)
        count = ones[which, bit]
        return high - (count[high] - count[low])

    while tops:
        bit, alo, ahi, blo, bhi, diff = tops.pop()
        if len(alo) > _BLOCK:
            half = len(alo) // 2
            tops += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, diff))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        few = ((ahi - alo) * (bhi - blo) <= _DIRECT) | (bit < 0)
        if few.any():
            _compare(a, b, same, budget, alo[few], ahi[few], blo[few], bhi[few], found)
            rest = ~few
            alo, ahi, blo, bhi, diff = (x[rest] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        amid = middle(0, a, bit, alo, ahi)
        bmid = middle(0 if same else 1, b, bit, blo, bhi)
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        nodes = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1),
                 tuple(x[~twin] for x in (amid, ahi, blo, bmid, diff + 1))]
        al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*nodes, strict=True))
        keep = (al < ah) & (bl < bh) & (d <= budget)
        tops.append((bit - 1, *(x[keep] for x in (al, ah, bl, bh, d))))


def _compare(a, b, same, budget, alo, ahi, blo, bhi, found) -> None:
    step = max(1, (1 << 22) // max(1, int(((ahi - alo) * (bhi - blo)).max())))
    for at in range(0, len(alo), step):
        al, bl, nb = alo[at:at + step], blo[at:at + step], (bhi - blo)[at:at + step]
        n = (ahi - alo)[at:at + step] * nb
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i, j = al[of] + k // nb[of], bl[of] + k % nb[of]
        if same:
            once = i < j
            i, j = i[once], j[once]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if near.any():
            found(i[near], j[near])


def _links(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    visits = pdf["visits"].to_numpy()
    values = pdf["fp"].to_numpy().view(np.uint64)
    own, guests = np.sort(values[~visits]), np.sort(values[visits])
    forest = _Forest(len(own) + len(guests))
    walk(own, own, True, budget, forest.add)
    walk(own, guests, False, budget, lambda i, j: forest.add(i, j + len(own)))
    all_of = np.concatenate((own, guests)).view(np.int64)
    hooked = np.flatnonzero(forest.root != np.arange(len(forest.root)))
    return pd.DataFrame({"a": all_of[hooked], "b": all_of[forest.root[hooked]]})


def near_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` whose components are those of all links within the budget."""
    n = distinct.count()
    depth = min(DEPTHS[1], max(DEPTHS[0], (max(0, n - 1) // NODE).bit_length()))
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    parts = np.ones(1 << depth, np.int64)
    for row in distinct.groupBy(prefix.alias("node")).count().where(F.col("count") > NODE).collect():  # 2^16 rows at most
        parts[row["node"]] = -(-row["count"] // NODE)
    first_part = np.cumsum(parts) - parts
    masks = [sum(1 << x for x in bits) for k in range(budget + 1) for bits in combinations(range(depth), k)]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            node = (fp >> np.uint64(64 - depth)).astype(np.int64)
            own = first_part[node] + ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts[node]
            for mask in masks:
                to = node ^ mask
                for k in range(int(parts[to].max(initial=0))):
                    at = first_part[to] + k
                    there = (parts[to] > k) & (at >= own)
                    yield pd.DataFrame({"part": at[there], "visits": at[there] > own[there], "fp": fp[there].view(np.int64)})

    dealt = distinct.select("fp").mapInPandas(deal, "part bigint, visits boolean, fp bigint")
    return dealt.groupBy("part").applyInPandas(lambda pdf: _links(pdf, budget), "a bigint, b bigint")


def near_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, text_key, fp, component_id, group) for each row of docs; group tells components apart even if ids repeat."""
    of_docs = saved(fingerprints(docs))
    nodes = saved(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("fp"), budget))
    rooted = nodes.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    ids = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(ids, "group").select("fp", "component_id", "group")
    return of_docs.join(of_fp, "fp", "left").select("doc_id", "text_key", "fp", "component_id", "group")


def deduplicated(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of each group: that with the least doc_id (nulls last), of several such rows one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = near_groups(docs, budget).groupBy("group").agg(first.alias("first")).select("first.*").select(id_key().alias("id"), F.col("text_key").alias("key"))
    rows = packed(docs).join(kept, ["id", "key"], "left_semi")
    turn = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))
    return rows.withColumn("turn", turn).where("turn = 1").select("row.*")
