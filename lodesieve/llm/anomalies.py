"""Quality rules as an isolation forest on rule statistics.

Each whole text is measured by rules (``RULES``): counts of words, symbols, repeated lines and repeated 3-word windows, and
shares made of them. Trees split random subsets of labelled good documents at random values of random rules; a text that
few splits cut off from them has a short path and a score near 1. The cut is calibrated on all labelled rows that may be
learnt from: their scores are binned by Spark, and the cut with the fewest wrong verdicts is taken (equal ones: the middle).

Two base rules stand before the forest: fewer than ``LEAST_WORDS`` words, or more than half of the words repeated, fails.

The forest is drawn from at most ``SAMPLE`` labelled rows, those of least hash; a repeated row counts once. The cut uses all
of them. With fewer than ``LEAST_ROWS`` good or bad rows to learn from, the base rules alone decide. Null, empty and blank
texts have no words and fail. Repeated rows get equal verdicts. Texts of any length are measured whole. Other columns of
docs play no part, except in ``kept_documents``, which carries them whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import packed, saved, text_key
from lodesieve.llm.fitting import summed, training_labels

MODULUS, REMAINDER = 4, 2   # of rows whose labels are not learnt from, so that verdicts can be tested on them
LEAST_WORDS = 50
REPEATED = 50               # per cent of the words in repeated windows, at most
WINDOW = 3
SAMPLE = 20_000             # labelled rows the trees are drawn from
LEAST_ROWS = 8              # good and bad rows without which nothing is learnt
TREES = 160
SUBSET = 256                # rows of one tree
DEPTH = 8                   # log2 of SUBSET
BINS = 2_000                # of scores, for the cut

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct_words", "top_word", "capitals", "digits", "marks", "short_words",
         "long_words", "line_words", "stops", "other_chars")

_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(x for x in range(33, 127) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122))
_LONG = 12  # characters of a long word, at least
_STOPS = (b".", b"!", b"?", "。".encode(), "؟".encode(), "।".encode())


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    window = ids[:n]
    for k in range(1, WINDOW):
        # Equal windows so far have equal numbers below n, so that the next key fits 64 bits.
        window = np.unique(window, return_inverse=True)[1] * np.int64(len(ids)) + ids[k:n + k]
    _, number, count = np.unique(window, return_inverse=True, return_counts=True)
    change = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(count[number] > 1)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measured(raw: bytes | None) -> tuple[tuple[int, ...], list[float]]:
    """The COUNTS and RULES of a text in UTF-8."""
    raw = raw or b""
    words, lines = raw.split(), [line for line in raw.split(b"\n") if line.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n, size = max(1, len(words)), max(1, len(raw))
    ink = b"".join(words)
    chars = int((np.frombuffer(ink, np.uint8) & 0xC0 != 0x80).sum())
    count = lambda some: len(ink) - len(ink.translate(None, some))
    symbols, dup_lines, repeats = count(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    rules = [math.log1p(len(words)), min(40.0, chars / n), symbols / size, dup_lines / max(1, len(lines)), repeats / n, len(seen) / n,
             int(np.bincount(ids, minlength=1).max()) / n, count(_UPPER) / size, count(_DIGITS) / size, count(_MARKS) / size, float((lengths < 4).sum()) / n,
             float((lengths >= _LONG).sum()) / n, min(200.0, n / max(1, len(lines))), sum(w.endswith(_STOPS) for w in words) / n, (size - chars) / size]
    return (len(words), chars, symbols, dup_lines, repeats), rules


def with_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, the COUNTS, rules) for each row of docs."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(raw.as_py()) for raw in batch.column(2)]
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            rules = pa.array([r for _, r in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, rules], names=["doc_id", "text_key", *COUNTS, "rules"])

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, f"doc_id {kind}, text_key bigint, {counts}, rules array<double>")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def _expected(n: np.ndarray) -> np.ndarray:
    """The mean path that n rows would still need to be told apart: that of failing searches in a binary search tree."""
    n = np.maximum(n, 1).astype(np.float64)
    return np.where(n < 2, 0.0, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n) - (n == 2) * (2 * np.euler_gamma - 2)


class Forest:
    """Random splits as complete binary trees of arrays: node k has the children 2k + 1 and 2k + 2; a leaf has no rule."""

    def __init__(self, rows: np.ndarray, seed: int = 13):
        draw = np.random.default_rng(seed)
        nodes = 2 ** (DEPTH + 1) - 1
        self.rule = np.full((TREES, nodes), -1, np.int64)
        self.value = np.zeros((TREES, nodes))
        self.path = np.zeros((TREES, nodes))
        self.usual = float(_expected(np.array([min(SUBSET, len(rows))]))[0]) or 1.0
        for tree in range(TREES):
            own = rows[draw.permutation(len(rows))[:SUBSET]]
            open_nodes = [(0, 0, own)]
            while open_nodes:
                node, depth, part = open_nodes.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                uneven = np.flatnonzero(high > low)
                if depth == DEPTH or not len(uneven):
                    self.path[tree, node] = depth + _expected(np.array([len(part)]))[0]
                    continue
                rule = draw.choice(uneven)
                value = draw.uniform(low[rule], high[rule])
                right = part[:, rule] > value
                self.rule[tree, node], self.value[tree, node] = rule, value
                open_nodes += [(2 * node + 1, depth + 1, part[~right]), (2 * node + 2, depth + 1, part[right])]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher: more of an anomaly."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for rule, value, path in zip(self.rule, self.value, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = rule[node]
                node = np.where(at < 0, node, 2 * node + 1 + (rows[every, at] > value[node]))
            total += path[node]
        return 2 ** (-total / TREES / self.usual)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), len(RULES))


def fit(labelled: DataFrame) -> tuple[Forest, float] | None:
    """The forest and its cut from (rules, y); None if there are too few rows to learn from."""
    few = labelled.agg(F.sum((F.col("y") >= 0.5).cast("long")).alias("good"), F.sum((F.col("y") < 0.5).cast("long")).alias("bad")).first()
    if min(few["good"] or 0, few["bad"] or 0) < LEAST_ROWS:
        return None
    # A share of the hashes first, so that tasks hand over about SAMPLE rows in all, not SAMPLE rows each.
    share = min(1.0, 1.5 * SAMPLE / few["good"])
    drawn = labelled.where((F.col("y") >= 0.5) & (F.pmod(F.xxhash64("rules"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("rules").distinct()
    good = drawn.orderBy(F.xxhash64("rules"), "rules").limit(SAMPLE).collect()  # SAMPLE rows at most
    forest = Forest(np.array([row["rules"] for row in good]))

    def binned(pdf) -> np.ndarray:
        at = np.minimum((forest.score(_matrix(pdf["rules"])) * BINS).astype(np.int64), BINS - 1)
        y = pdf["y"].to_numpy(np.float64)
        return np.concatenate((np.bincount(at, y >= 0.5, BINS), np.bincount(at, y < 0.5, BINS)))

    good_at, bad_at = summed(labelled.select("rules", "y"), binned, 2 * BINS).reshape(2, BINS)
    # Scores below cut k / BINS are kept: wrong are the bad ones there and the good ones from k on.
    wrong = np.concatenate(([0], np.cumsum(bad_at))) + good_at.sum() - np.concatenate(([0], np.cumsum(good_at)))
    best = np.flatnonzero(wrong == wrong.min())
    return forest, float(best[0] + best[-1]) / 2 / BINS


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_key, the COUNTS, base_failed, anomaly, kept) for each row of docs.

    anomaly is the forest's score, null if nothing was learnt; documents that fail the base rules are no part of its lessons.
    """
    rules = saved(with_rules(docs).withColumn("base_failed", base_failed()))
    known = training_labels(labels, "quality", MODULUS, REMAINDER)
    labelled = saved(rules.where(~F.col("base_failed")).join(known, rules["doc_id"] == known["label_id"]).select("rules", "y"))
    learnt = fit(labelled)
    if learnt is None:
        anomaly, usual = F.lit(None).cast("double"), F.lit(True)
    else:
        forest, cut = learnt

        @F.pandas_udf("double")
        def score(column):
            import pandas as pd

            return pd.Series(forest.score(_matrix(column)))

        anomaly, usual = score("rules"), F.col("anomaly") < cut
    return rules.withColumn("anomaly", anomaly).select("doc_id", "text_key", *COUNTS, "base_failed", "anomaly", (~F.col("base_failed") & usual).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the forest."""
    kept = judge(docs, labels).where("kept").select("doc_id", "text_key").distinct()
    kept = kept.select(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("id"), F.col("text_key").alias("key"))
    return packed(docs).join(kept, ["id", "key"], "left_semi").select("row.*")
