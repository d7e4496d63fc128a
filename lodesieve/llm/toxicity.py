"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters are words and beginnings of words that mark toxic texts in a bounded sample (``SAMPLE``) of labelled rows, and patterns of the
text's form, among them silence of the lexicon. A voter fires or abstains, and only firing tells something. The label model is a mixture of two classes over all documents: each voter has a rate of
firing in either class, learnt by expectation maximisation over the patterns of votes (labels that may be seen are fixed).
Voters that fire together more often than their rates explain are correlated; their votes are discounted by the sum of
their squared correlations. The posterior labels of a bounded sample of documents, labelled or not, train a logistic regression on the
votes and their density.

A null text counts as empty: no lexicon voter fires, and it is scored like any other. Repeated rows get equal scores. With fewer
than ``LEAST_ROWS`` toxic or other labelled rows nothing is learnt: every score is low and no document is rejected. Texts of any
length are read whole. Other columns play no part, except in ``clean``, which carries them. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import saved
from lodesieve.llm.fitting import held_out, summed, training_labels

MODULUS, REMAINDER, THRESHOLD = 3, 1, 0.7
SAMPLE = 20_000        # labelled rows that the lexicon and the classifier are fitted on, at most; the classifier sees as many unlabelled ones
LEAST_ROWS = 10        # toxic and other labelled rows without which nothing is learnt
LEXICON = 300          # words and beginnings, at most
LEAST_DOCS = 2         # toxic texts that a term must mark, at least
LEAST_SHARE = 0.012    # of all toxic texts of the sample, likewise
DEPTH = 2              # terms that should mark a toxic text
LEAST_ODDS = 2.2       # natural logarithm, between toxic and other texts
HEADS = (4, 5, 6)      # lengths of beginnings; the first one also gates all lookups
ROUNDS = 8             # of expectation maximisation
TRUST = 0.97           # of a label, as a voter
PATTERNS = ("shouting", "bangs", "shouted_words", "quiet")

_TO_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))


def distinct_words(text: str | None) -> tuple[Counter, int]:
    words = (text or "").encode("utf-8", "replace").translate(_TO_WORDS).decode("utf-8", "replace").split()
    return Counter(words), len(words)


def terms_of(word: str) -> list[str]:
    """A word as a whole (marked by a final blank) and its beginnings."""
    return [word + " ", *(word[:n] for n in HEADS if len(word) > n)]


def mined_lexicon(sample: DataFrame) -> list[str]:
    """Terms that mark the toxic rows of ``sample(text, y)``, by likelihood ratio; a term that another one covers is left out."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seen: dict[str, list[float]] = {}
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                for term in {t for w in distinct_words(text)[0] for t in terms_of(w)}:
                    both = seen.setdefault(term, [0.0, 0.0])
                    both[0] += y
                    both[1] += 1
            yield pd.DataFrame({"term": list(seen), "toxic": [x[0] for x in seen.values()], "docs": [x[1] for x in seen.values()]})

    totals = sample.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("docs")).first()
    toxic, docs = totals["toxic"] or 0.0, totals["docs"]
    if not 0 < toxic < docs:
        return []
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    counts = sample.mapInPandas(count, "term string, toxic double, docs double").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("docs").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (docs - toxic + 1))
    best = counts.withColumn("odds", odds).where((F.col("t") >= least) & (F.col("odds") >= LEAST_ODDS))
    offered = {row["term"]: row["odds"] for row in best.orderBy((F.col("t") * F.col("odds")).desc(), "term").limit(4 * LEXICON).collect()}
    voters = Voters(list(offered))
    marked = with_votes(sample.where("y > 0.5").select(F.lit(0).alias("doc_id"), "text"), voters).select("fired").toPandas()  # SAMPLE rows at most
    return sorted(_covering([[i for i in own if i < len(offered)] for own in marked["fired"]], voters.lexicon, list(offered.values()), least))


def _same(a: str, b: str) -> bool:
    return a.startswith(b.rstrip(" ")) or b.startswith(a.rstrip(" "))


def _covering(fired: list[list[int]], terms: list[str], odds: list[float], least: int) -> list[str]:
    """Terms that mark texts which fewer than ``DEPTH`` chosen terms mark, one by one, best first.

    Words that merely stand in copies of one toxic text add nothing and stay out.
    """
    texts: dict[int, list[int]] = {}
    for text, own in enumerate(fired):
        for i in own:
            texts.setdefault(i, []).append(text)
    depth, chosen = [0] * len(fired), []
    while texts and len(chosen) < LEXICON:
        gains = {i: sum(depth[t] < DEPTH for t in own) for i, own in texts.items()}
        texts = {i: own for i, own in texts.items() if gains[i] >= least and not any(_same(terms[i], c) for c in chosen)}
        if not texts:
            break
        pick = max(texts, key=lambda i: (gains[i] * odds[i], terms[i]))
        chosen.append(terms[pick])
        for text in texts.pop(pick):
            depth[text] += 1
    return chosen


class Voters:
    def __init__(self, lexicon: list[str]):
        self.lexicon = lexicon
        self.of = {term: i for i, term in enumerate(lexicon)}
        self.heads = {term.rstrip(" ")[:HEADS[0]] for term in lexicon}
        self.n = len(lexicon) + len(PATTERNS)

    def votes(self, text: str | None) -> tuple[list[int], int, int]:
        """(voters that fire, words that lexicon voters fire on, words)"""
        words, n = distinct_words(text)
        fired: set[int] = set()
        hits = 0
        head, heads, of = HEADS[0], self.heads, self.of
        for word in words:
            if word[:head] in heads and (own := [of[t] for t in terms_of(word) if t in of]):
                fired.update(own)
                hits += words[word]
        raw = text or ""
        upper = sum(map(raw.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        shown = (upper > 0.5 * max(1, len(raw)), raw.count("!") > 0.2 * max(1, n), n > 0 and upper > 4 * n, hits == 0)
        return sorted(fired) + [len(self.lexicon) + i for i, x in enumerate(shown) if x], hits, n


def with_votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, fired, hits, words)"""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [voters.votes(x.as_py()) for x in batch.column(1)]
            fired, hits, words = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32())), pa.array(hits, pa.int64()), pa.array(words, pa.int64())],
                                             names=["doc_id", "fired", "hits", "words"])

    return rows.mapInArrow(run, f"doc_id {kind}, fired array<int>, hits bigint, words bigint")


def _dense(fired: pd.Series, n: int) -> np.ndarray:
    out = np.zeros((len(fired), n))
    for i, own in enumerate(fired):
        out[i, np.asarray(own, int)] = 1
    return out


class LabelModel:
    """Rates of firing by class, prior, and the discount of correlated voters."""

    def __init__(self, n: int):
        self.n = n
        self.prior = 0.05
        self.rates = np.vstack((np.full(n, 0.01), np.full(n, 0.3)))
        self.discount = np.ones(n)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1]) - np.log(self.rates[0])
        logit = math.log(self.prior / (1 - self.prior)) + votes @ (on * self.discount)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def soft(self, pdf: pd.DataFrame, votes: np.ndarray) -> np.ndarray:
        """Posterior labels; where a label may be seen, that label."""
        y = pdf["y"].to_numpy(np.float64)
        return np.where(np.isnan(y), self.posterior(votes), y)

    def told(self, pdf: pd.DataFrame, votes: np.ndarray) -> np.ndarray:
        """Posterior labels in which a label that may be seen is one more voter, right with probability ``TRUST``."""
        p = np.clip(self.posterior(votes), 1e-12, 1 - 1e-12)
        label = np.nan_to_num(2 * pdf["y"].to_numpy(np.float64) - 1) * math.log(TRUST / (1 - TRUST))
        return 1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + label, -40, 40)))

    def fit(self, patterns: DataFrame) -> LabelModel:
        """patterns: (fired, y, n): how many documents have these votes and this label, null if there is none to see."""
        n = self.n
        for step in range(ROUNDS):
            def expected(pdf: pd.DataFrame, first: bool = step == 0) -> np.ndarray:
                votes, weight = _dense(pdf["fired"], n), pdf["n"].to_numpy(np.float64)
                y = self.soft(pdf, votes)
                if first:  # the first rates come from the labels alone
                    weight = np.where(pdf["y"].isna(), 0, weight)
                    y = np.nan_to_num(y)
                return np.concatenate(([((1 - y) * weight).sum(), (y * weight).sum()], ((1 - y) * weight) @ votes, (y * weight) @ votes))

            sums = summed(patterns, expected, 2 * n + 2)
            if sums[:2].min() <= 0:
                break
            self.prior = min(0.999, max(1e-4, sums[1] / sums[:2].sum()))
            self.rates = (sums[2:].reshape(2, n) + np.array([[0.05], [0.5]])) / (sums[:2].reshape(2, 1) + 2.0)

        def together(pdf: pd.DataFrame) -> np.ndarray:
            votes = _dense(pdf["fired"], n)
            weight = pdf["n"].to_numpy(np.float64) * self.soft(pdf, votes)
            return np.concatenate(((votes.T * weight) @ votes, [[weight.sum()] + [0] * (n - 1)])).ravel()

        sums = summed(patterns, together, n * n + n)
        mass = max(1e-9, sums[n * n])
        joint, rate = sums[:n * n].reshape(n, n) / mass, self.rates[1]
        spread = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate)))
        correlation = np.clip((joint - np.outer(rate, rate)) / np.maximum(spread, 1e-9), 0, 1)
        np.fill_diagonal(correlation, 0)
        correlation[correlation < 0.35] = 0
        self.discount = 1 / (1 + (correlation**2).sum(axis=1))
        return self


class Linear:
    """Logistic regression on votes, their density and length; rows weigh their class equally up to a factor."""

    def __init__(self, n: int):
        self.n = n
        self.weights = np.zeros(n + 4)
        self.weights[-1] = -3.0

    def features(self, pdf: pd.DataFrame) -> np.ndarray:
        votes = _dense(pdf["fired"], self.n)
        hits, words = pdf["hits"].to_numpy(np.float64), pdf["words"].to_numpy(np.float64)
        return np.column_stack((votes, np.log1p(hits), np.minimum(1, 50 * hits / np.maximum(1, words)), np.log1p(words) / 10, np.ones(len(pdf))))

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 25) -> Linear:
        pull = np.full(x.shape[1], penalty)
        pull[-1] = 1e-6
        w = self.weights
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            slope = x.T @ (p - y) + pull * w
            curve = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(pull)
            move = np.linalg.solve(curve, slope)
            w = w - move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
            if np.abs(move).max() < 1e-6:
                break
        self.weights = w
        return self

    def score(self, pdf: pd.DataFrame) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(pdf) @ self.weights, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Voters, Linear, DataFrame]:
    """The voters, the classifier, and the votes of all documents."""
    docs = docs.select("doc_id", "text")
    known = saved(training_labels(labels, "toxic", MODULUS, REMAINDER))
    ids = saved(known.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE))
    sample = docs.join(F.broadcast(ids), docs["doc_id"] == ids["label_id"])  # the broadcast has SAMPLE rows at most
    # One text of each id, so that a repeated id does not make the sample larger.
    sample = sample.groupBy("label_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")
    voters = Voters(mined_lexicon(saved(sample)))
    votes = saved(with_votes(docs, voters))
    seen = votes.join(known, votes["doc_id"] == known["label_id"], "left")
    patterns = saved(seen.groupBy("fired", "y").agg(F.count(F.lit(1)).alias("n")))
    model = LabelModel(voters.n).fit(patterns)
    toxic, other, unknown = seen.agg(F.count_if(F.col("y") >= 0.5), F.count_if(F.col("y") < 0.5), F.count_if(F.col("y").isNull())).first()
    linear = Linear(voters.n)
    if min(toxic, other) >= LEAST_ROWS:
        rows = pd.concat([_drawn(seen.where("y is not null"), toxic + other), _drawn(seen.where("y is null"), unknown)], ignore_index=True)
        linear.fit(linear.features(rows), model.told(rows, _dense(rows["fired"], voters.n)))
    return voters, linear, votes


def _drawn(rows: DataFrame, n: int) -> pd.DataFrame:
    """At most ``SAMPLE`` of n rows, by a hash of their ids; a share of the hashes first, so that tasks do not hand over SAMPLE rows each."""
    order = F.xxhash64(F.lit(5), "doc_id", "hits", "words")
    some = rows.where(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 1.5 * SAMPLE / max(1, n)) * (1 << 30)))
    return some.select("fired", "hits", "words", "y", order.alias("order")).orderBy("order", "hits", "words").limit(SAMPLE).toPandas()


def _graded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    _, linear, votes = fit(docs, labels)

    @F.pandas_udf("double")
    def score(fired: pd.Series, hits: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series(linear.score(pd.DataFrame({"fired": fired, "hits": hits, "words": words})))

    return _graded(votes.select("doc_id", held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), score("fired", "hits", "words").alias("score")))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic."""
    voters, linear, _ = fit(docs, labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        fired, hits, words = zip(*map(voters.votes, text), strict=True) if len(text) else ((), (), ())
        return pd.Series(linear.score(pd.DataFrame({"fired": fired, "hits": hits, "words": words})))

    return docs.where(score("text") < THRESHOLD)
