"""Periodic runs, ranked search and the rule forest against brute force and held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesieve.llm import anomalies, lexical, periodic
from lodesieve.llm.fitting import held_out

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_runs(x):
    """Every stretch, longest first from each start, with its smallest period."""
    n, found = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                    all(x[m] == x[m + p] for m in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    words = "abcd"[: draw.randint(1, 4)]
    x = []
    while len(x) < draw.randint(0, 150):
        piece = [draw.choice(words) for _ in range(draw.randint(1, 12))]
        x += (piece * draw.randint(1, 6))[: draw.randint(1, 60)]
        x += [draw.choice("xyzuvw")] * draw.randint(0, 1)
    ids = periodic.numbered_words([w.encode() for w in x])
    runs = periodic.runs_of(ids)
    assert runs == brute_runs(x)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    assert periodic.kept_words(x, runs) == [w for k, w in enumerate(x) if k not in gone]
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    assert periodic.strongest(runs) == best


def test_long_texts_end_soon():
    draw = np.random.default_rng(1)
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    prose = draw.integers(0, 2_000, 100_000)
    assert periodic.runs_of(prose) == []
    period = draw.integers(0, 5_000, 9_000)
    long = np.concatenate((prose, np.tile(period, 5)[:40_000], prose[:500]))
    assert [(n // q, q) for _, n, q in periodic.runs_of(long)] == [(4, 9_000)]
    nested = np.tile(np.concatenate((np.repeat([1, 2], [7, 1]), [3])), 30)
    assert (0, 270, 9) in periodic.runs_of(nested) and sum(q == 1 for _, _, q in periodic.runs_of(nested)) == 30


def test_run_rows(spark, docs, no_docs):
    found = periodic.find_runs(docs).collect()
    assert len(found) == docs.count()
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r.doc_id, []).append(WORDS.findall(r.text or ""))
    for r in found:
        assert (r.n_words, r.collapsed) in {(len(w), " ".join(periodic.kept_words(w, brute_runs(w) if len(w) < 900 else []))) for w in by_text[r.doc_id]}
        assert (r.strongest is None) == (not r.runs)
    assert [tuple(x) for r in found if r.n_words == 400 for x in r.runs] == [(0, 400, 1)]
    assert periodic.find_runs(no_docs).count() == 0
    clash = docs.withColumn("runs", F.lit(1)).withColumn("raw", F.col("text")).withColumn("n_words", F.lit(None).cast("int"))
    out = periodic.collapsed(clash)
    assert out.columns == clash.columns and out.where("text is null").count() == docs.where("text is null").count()
    assert out.where("doc_id = 79 and text = 'a'").count() == docs.where("doc_id = 79 and text like 'a a %'").count()


def brute_ranks(docs, items, top):
    terms = [(i, TERMS.findall(lower(t))) for i, t in docs]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(w for _, c, _ in terms for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in terms:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                        for w in TERMS.findall(lower(text)) if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return out


@pytest.fixture(scope="module")
def items(spark, docs):
    draw = random.Random(9)
    texts = [t for (t,) in docs.where("length(text) > 60").select("text").collect()]
    rows = [(f"i{k}", " ".join(draw.choices(draw.choice(texts).split(), k=draw.randint(1, 30)))) for k in range(25)]
    rows += [("i1", "KA ka ka"), (None, rows[0][1]), ("none", None), ("blank", " .,!"), ("unknown", "nothing-of-this"), ("ü", "rü RÜ rÜb")]
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("block, exact", [(lexical.BLOCK_POSTINGS, lexical._EXACT), (40, 0)])
def test_ranks_equal_brute_force(docs, items, monkeypatch, block, exact):
    for name, value in (("BLOCK_POSTINGS", block), ("_EXACT", exact), ("_CELLS", 64 if exact == 0 else lexical._CELLS), ("_HELD", 50)):
        monkeypatch.setattr(lexical, name, value)
    want = brute_ranks([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()], 10)
    got = [tuple(r) for r in lexical.rank_documents(docs.withColumn("rank", F.lit(0)).withColumn("item", F.lit("x")), items).collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ranks_of_ties_and_nothing(spark, docs, no_docs, items):
    same = spark.range(5_000).select((F.col("id") % 2500).alias("doc_id"), F.lit("one hot row").alias("text")).repartition(7)
    other = spark.range(9_000, 12_000).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text"))
    got = lexical.rank_documents(same.union(other), spark.createDataFrame([(1, "hot")], "item_id int, text string"), 4)
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert lexical.rank_documents(no_docs, items).count() == 0 and lexical.rank_documents(docs, items.limit(0)).count() == 0


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


@pytest.mark.parametrize("seed", range(20))
def test_counts_equal_brute_force(seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(["a ", "b ", "ü x ", "# ", "\n", "a b\n", "line|\r\n", "\x1c", "<<"]) for _ in range(draw.randint(0, 200)))
    assert anomalies.measured(text.encode())[0] == brute_counts(text)


def test_verdicts(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = anomalies.judge(docs, labels).collect()
    want = Counter((r.doc_id, *brute_counts(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, *(r[c] for c in anomalies.COUNTS)) for r in rows) == want
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept, r.anomaly) == (failed, not failed, None)
    assert anomalies.judge(no_docs, labels).count() == 0
    kept = anomalies.kept_documents(docs.withColumn("kept", F.lit("mine")).withColumn("rules", F.lit(0)), labels)
    assert kept.count() == sum(r.kept for r in rows) and kept.columns == [*docs.columns, "kept", "rules"]


def test_forest_tells_junk_on_held_out_rows(spark):
    draw = random.Random(2)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("", "n", "rs", "t")]
    good = [" ".join(draw.choices(words, k=draw.randint(60, 300))) + "." for _ in range(600)]
    junk = [" ".join(draw.choice(["#", "$$", "%X9", "A1B2", "&&&"]) + str(draw.randint(0, 9999)) for _ in range(draw.randint(60, 300))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id bigint, text string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") < 600).cast("int").alias("quality"))
    rows = anomalies.judge(docs, labels.union(labels)).collect()
    held = {r.doc_id for r in docs.where(held_out(F.col("doc_id"), anomalies.MODULUS, anomalies.REMAINDER)).collect()}
    assert len(held) > 100 and sum(r.kept == (r.doc_id < 600) for r in rows if r.doc_id in held) >= 0.97 * len(held)
    again = anomalies.judge(docs.repartition(7), labels).select("doc_id", "kept").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.kept) for r in rows)
