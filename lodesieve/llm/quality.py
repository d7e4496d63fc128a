"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (``STATISTICS``) are standardised over all documents and mapped to cosines of random
directions, whose inner products approximate a Gaussian kernel. The normal equations of the ridge regression are summed
partition by partition over all labelled rows that may be learnt from. Their scores are binned, and pooling adjacent
violators turns the bins' shares of good documents into a rising curve, the calibration.

A null text counts as empty and is scored like any other. Repeated rows get equal scores. Without labels every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import saved
from lodesieve.llm.fitting import held_out, summed, training_labels

MODULUS, REMAINDER, THRESHOLD = 4, 2, 0.7
FEATURES = 160      # random directions
WIDTH = 4.0         # of the kernel, in standard deviations of the statistics
RIDGE = 1e-5        # per row
BINS = 400          # of the calibration
CLIP = 5.0          # standard deviations

STATISTICS = ("log_words", "word_length", "distinct_words", "top_word", "repeated_word", "distinct_pairs", "capitals", "digits", "marks", "bangs", "bars",
              "symbols", "other_bytes", "lines", "distinct_lines", "short_words", "capital_words")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/|"
_MARKS = bytes(x for x in range(33, 127) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda some: (len(raw) - len(raw.translate(None, some))) / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, lower = share(_UPPER), share(_LOWER)
    after = words[1:]
    return [math.log1p(len(words)), min(40.0, size / n), len(counts) / n, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, after)) / n,
            len(set(zip(words, after, strict=False))) / n, upper / max(1e-9, upper + lower), share(_DIGITS), share(_MARKS), min(3.0, raw.count(b"!") / n),
            min(3.0, raw.count(b"|") / n), share(_SYMBOLS), 1 - share(bytes(range(128))), (len(lines) - 1) / n, len(set(lines)) / len(lines),
            sum(len(w) < 4 for w in words) / n, sum(w[0] in _UPPER for w in words) / n]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats)"""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return rows.mapInArrow(run, f"doc_id {kind}, stats array<double>")


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to values: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


class Model:
    """Statistics to calibrated scores."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-12, std, 1.0)
        self.directions = draw.standard_normal((len(mean), FEATURES)) / WIDTH
        self.phases = draw.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -CLIP, CLIP)
        return np.column_stack((math.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.phases), np.ones(len(x))))

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(stats), *self.curve), 0, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), len(STATISTICS))


def fit(stats: DataFrame, labelled: DataFrame) -> Model:
    """stats: all documents; labelled: (stats, y) of those that may be learnt from."""
    k, d = len(STATISTICS), FEATURES + 1

    def moments(pdf: pd.DataFrame) -> np.ndarray:
        x = _matrix(pdf["stats"])
        return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))

    total = summed(stats.select("stats"), moments, 2 * k + 1)
    n = max(1.0, total[0])
    mean = total[1:k + 1] / n
    model = Model(mean, np.sqrt(np.maximum(0, total[k + 1:] / n - mean**2)))
    upper = np.triu_indices(d)

    def equations(pdf: pd.DataFrame) -> np.ndarray:
        z, y = model.features(_matrix(pdf["stats"])), pdf["y"].to_numpy(np.float64)
        return np.concatenate(((z.T @ z)[upper], z.T @ y))

    sums = summed(labelled.select("stats", "y"), equations, len(upper[0]) + d)
    gram = np.zeros((d, d))
    gram[upper] = sums[:len(upper[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    rows = gram[-1, -1]
    if rows == 0:
        return model
    model.weights = np.linalg.solve(gram + RIDGE * rows * np.eye(d), sums[len(upper[0]):])

    def bins(pdf: pd.DataFrame) -> np.ndarray:
        r = model.ridge(_matrix(pdf["stats"]))
        at = np.clip(np.floor((r + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, r, BINS), np.bincount(at, pdf["y"], BINS)))

    count, score, good = summed(labelled.select("stats", "y"), bins, 3 * BINS).reshape(3, BINS)
    full = count > 0
    model.curve = (score[full] / count[full], pooled(good[full] / count[full], count[full]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    stats = saved(with_statistics(docs))
    known = training_labels(labels, "quality", MODULUS, REMAINDER)
    labelled = saved(stats.join(known, stats["doc_id"] == known["label_id"]).select("stats", "y"))
    model = fit(stats, labelled)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(column)))

    scored = stats.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
