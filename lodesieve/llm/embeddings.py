"""Embedding near-dedup with an inverted multi-index.

Each half of the unit vectors has a codebook of its own (k-means on a bounded sample); the product of the two is a grid of
cells that every vector is filed in. A vector visits the cells of its label from the nearest on, by multi-sequence traversal
of the two sorted codebooks, and verifies the cosine with what is filed there. A cell's distance is a lower bound: the vector
must at least reach the bisecting planes that bound the cell in either half. Traversal ends at the distance within which the
target recall is reached among partners at the least cosine: real ones of the sample, and drawn ones in random directions,
whichever lie farther. Nearer partners are found more often. (The worst case, a limit of 2 - 2 cosine, loses nothing but visits
nearly all cells in 64 dimensions.)

Equal vectors of a label are one class with a count, so copies cost one row. Members of a crowded cell are dealt out in
parts that all meet. Blocks return counts of links and a spanning forest, never pairs.

Vectors that are null, zero or hold null, NaN or infinite components, and vectors without a label, link with nothing. Vectors
of unequal length never link. Repeated rows are vectors of their own. component_id is the least vec_id of a component.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import saved
from lodesieve.llm.components import components
from lodesieve.llm.simhash import _Forest

COSINE = 0.93
SAMPLE = 8192    # vectors that the codebooks are fitted on, at most
FILED = 1024     # vectors in a cell, on average over all labels
MOST_CODES = 64  # of a codebook
BLOCK = 2048     # vectors on a side of a comparison
RECALL = 0.998   # of partners at the least cosine
DRAWN = 4        # partners drawn for each vector of the sample


def codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; ties and empty codes keep what they have."""
    draw = np.random.default_rng(seed)
    codes = points[np.sort(draw.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        near = _distances(points, codes).argmin(axis=1)
        for c in range(len(codes)):
            if (near == c).any():
                codes[c] = points[near == c].mean(axis=0)
    return np.unique(codes, axis=0)


def _distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes**2).sum(axis=1))


def bounds(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances that points have from the Voronoi cell of each code, at least; 0 for their own."""
    d = _distances(points, codes)
    apart = np.sqrt(_distances(codes, codes))
    out = np.zeros_like(d)
    for c in range(len(codes)):
        others = np.arange(len(codes)) != c
        if others.any():
            out[:, c] = np.maximum(0, ((d[:, [c]] - d[:, others]) / (2 * np.maximum(apart[c, others], 1e-12))).max(axis=1))
    return out**2


def multi_sequence(left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells of the product grid by rising sum of distances, up to the limit."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        far, i, j = heapq.heappop(heap)
        if far > limit:
            return
        yield a[i], b[j]
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))


def unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Grid:
    def __init__(self, sample: np.ndarray, k: int, seed: int = 3):
        self.half = (sample.shape[1] + 1) // 2
        self.codes = codebook(sample[:, :self.half], k, seed), codebook(sample[:, self.half:], k, seed + 1)

    def limit(self, sample: np.ndarray, cosine: float, recall: float, seed: int = 5) -> float:
        """How far the traversal goes."""
        draw, needed = np.random.default_rng(seed), []
        for _ in range(DRAWN):
            noise = draw.standard_normal(sample.shape)
            noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
            noise /= np.maximum(1e-12, np.sqrt((noise**2).sum(axis=1, keepdims=True)))
            needed.append(self.apart(sample, cosine * sample + math.sqrt(1 - cosine**2) * noise))
        far = float(np.quantile(np.concatenate(needed), recall))
        real = []
        for at in range(0, len(sample), BLOCK):
            i, j = np.nonzero(np.triu(sample[at:at + BLOCK] @ sample.T, at + 1) >= cosine)
            real.append(self.apart(sample[i + at], sample[j]))
        real = np.concatenate(real)
        return min(2 - 2 * cosine, max(far, float(np.quantile(real, recall)) if len(real) else 0.0)) + 1e-9

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The distance of each x from the cell of its y."""
        total = np.zeros(len(x))
        for codes, side in zip(self.codes, (slice(None, self.half), slice(self.half, None)), strict=True):
            if len(x):
                total += bounds(x[:, side], codes)[np.arange(len(x)), _distances(y[:, side], codes).argmin(axis=1)]
        return total

    def place(self, units: np.ndarray, limit: float) -> tuple[np.ndarray, list[list[int]]]:
        """Each vector's cell, and the cells above it that it visits."""
        left, right = bounds(units[:, :self.half], self.codes[0]), bounds(units[:, self.half:], self.codes[1])
        width = len(self.codes[1])
        own = left.argmin(axis=1) * width + right.argmin(axis=1)
        visits = [[c for i, j in multi_sequence(x, y, limit) if (c := i * width + j) > o] for x, y, o in zip(left, right, own.tolist(), strict=True)]
        return own, visits


def _compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
    part = pdf["part"].to_numpy()
    sides = [np.flatnonzero(part == a), np.flatnonzero(part == b)]
    units, n = unit(pdf["embedding"]), pdf["n"].to_numpy(np.int64)
    links, forest = np.zeros(len(pdf), np.int64), _Forest(len(pdf))
    for at in range(0, len(sides[0]), BLOCK):
        rows = sides[0][at:at + BLOCK]
        for to in range(at if a == b else 0, len(sides[1]), BLOCK):
            cols = sides[1][to:to + BLOCK]
            near = units[rows] @ units[cols].T >= cosine
            if a == b and at == to:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            links[rows] += near @ n[cols]
            links[cols] += near.T @ n[rows]
            forest.add(rows[i], cols[j])
    ids = pdf["class_id"].to_numpy()
    some = links > 0
    return pd.DataFrame({"class_id": ids[some], "links": links[some], "root": ids[forest.root[some]]})


def near_links(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(class_id, links, root): shares of the links of each class, and another class of its component.

    classes: (class_id, label, dim, embedding, n), all valid.
    """
    counts = classes.groupBy("dim").count().collect()  # one row per length of vectors
    out = None
    for dim, total in sorted((r["dim"], r["count"]) for r in counts):
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("class_id")).limit(SAMPLE).select("embedding").toPandas()
        points = unit(sample["embedding"])
        grid = Grid(points, min(MOST_CODES, max(2, math.ceil(math.sqrt(total / FILED)))))
        found = _dim_links(own, grid, cosine, grid.limit(points, cosine, recall))
        out = found if out is None else out.union(found)
    return out


def _dim_links(classes: DataFrame, grid: Grid, cosine: float, limit: float) -> DataFrame:
    @F.pandas_udf("struct<own:int,visits:array<int>>")
    def place(embedding: pd.Series) -> pd.DataFrame:
        own, visits = grid.place(unit(embedding), limit)
        return pd.DataFrame({"own": own, "visits": visits})

    placed = classes.withColumn("at", place("embedding"))
    filed = F.transform(F.array("at.own"), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("filed")))
    seen = F.transform("at.visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("filed")))
    members = saved(placed.select("class_id", "label", "n", "embedding", F.explode(F.concat(filed, seen)).alias("to"))
                    .select("class_id", "label", "n", "embedding", "to.cell", "to.filed"))
    sizes = members.groupBy("label", "cell").agg(F.count_if("filed").alias("in"), F.count_if(~F.col("filed")).alias("out")).where(F.col("in") > 0)
    sizes = sizes.select("label", "cell", F.ceil(F.col("in") / BLOCK).alias("ins"), F.ceil(F.col("out") / BLOCK).alias("outs"))
    draw = F.xxhash64("class_id")
    dealt = (members.join(sizes, ["label", "cell"])
             .withColumn("part", F.when(F.col("filed"), F.pmod(draw, F.col("ins"))).otherwise(F.col("ins") + F.pmod(draw, F.greatest("outs", F.lit(1))))))
    # A filed part meets all parts, a visiting part all filed ones.
    others = F.when(F.col("filed"), F.sequence(F.lit(0).cast("long"), F.col("ins") + F.col("outs") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("ins") - 1))
    blocks = (dealt.withColumn("other", F.explode(others)).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
              .select("label", "cell", "a", "b", "part", "class_id", "n", "embedding"))
    return blocks.groupBy("label", "cell", "a", "b").applyInPandas(lambda pdf: _compare(pdf, cosine), "class_id bigint, links bigint, root bigint")


def near_groups(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    x = F.col("embedding")
    valid = (x.isNotNull() & F.col("label").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))) & F.exists(x, lambda v: v != 0))
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(valid, F.lit(False)).alias("valid"))
    classes = saved(rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
                    .withColumn("class_id", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = near_links(classes, cosine, recall)
    if found is None:
        return alone
    found = saved(found)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    rooted = classes.join(roots, F.col("class_id") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "class_id"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    graded = (rooted.join(ids, "root").join(links, "class_id", "left")
              .select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = rows.where("valid").join(graded, ["label", "embedding"])
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).union(alone)
