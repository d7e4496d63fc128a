"""SimHash groups, decontamination, embeddings, repeated passages, components."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodesieve.llm import components, decontaminate, embeddings, simhash, substrings

VECTORS = "vec_id bigint, embedding array<float>, label int"


def _groups(n, linked):
    """The least member of each item's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_components_of_random_graphs(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(30)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    at, pairs = {x: i for i, x in enumerate(nodes)}, {frozenset(e) for e in edges}
    want = _groups(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in pairs)
    assert found == {x: nodes[want[at[x]]] for x in nodes}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    votes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def test_simhash_groups(spark, docs, no_docs):
    rows = docs.collect()
    prints = [_fingerprint(r["text"]) for r in rows]
    group = _groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = [min((rows[j]["doc_id"] for j in range(len(rows)) if group[j] == g and rows[j]["doc_id"] is not None), default=None) for g in group]
    found = simhash.near_groups(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found) == Counter(zip((r["doc_id"] for r in rows), prints, least, strict=True))
    kept = simhash.deduplicated(docs.withColumn("group", F.lit("mine")).withColumn("KEY", F.lit("mine"))).collect()
    assert len(kept) == len(set(group)) and {r["doc_id"] for r in kept} == set(least) and all(r["group"] == r["KEY"] == "mine" for r in kept)
    assert simhash.near_groups(no_docs).count() == 0 == simhash.deduplicated(no_docs).count()


def test_votes_are_counted_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_VOTES", 64)
    assert simhash.fingerprint(text) == whole == _fingerprint(text)


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_trie_finds_all_links(spark, monkeypatch, limit):
    """Nodes in one or many parts, deep or shallow: the same components."""
    draw = np.random.default_rng(limit)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    base[:20] >>= np.uint64(30)  # a crowded node
    flips = [np.bitwise_xor.reduce(np.uint64(1) << draw.integers(0, 64, (2, 40), dtype=np.uint64), axis=0) for _ in range(6)]
    values = np.unique(np.concatenate([base, *(base ^ f for f in flips)]))
    monkeypatch.setattr(simhash, "NODE", limit)
    monkeypatch.setattr(simhash, "DEPTHS", (4, 6))
    monkeypatch.setattr(simhash, "_BLOCK", 16)
    signed = values.view(np.int64)
    edges = simhash.near_links(spark.createDataFrame([(int(x),) for x in signed], "fp bigint"))
    roots = dict(map(tuple, components.components(edges).collect()))
    want = _groups(len(values), lambda i, j: int(values[i] ^ values[j]).bit_count() <= 2)
    least = {g: min(int(signed[k]) for k in range(len(values)) if want[k] == g) for g in set(want)}
    assert [roots.get(int(x), int(x)) for x in signed] == [least[g] for g in want]


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _leaks(docs, items):
    windows = {}
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i:i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    for r in docs:
        words = _words(r["text"])
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i:i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        yield r["doc_id"], len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block, shard", [(1 << 20, 1 << 20), (12, 50)])
def test_leaks_by_brute_force(spark, docs, monkeypatch, block, shard):
    texts = [r["text"] for r in docs.where("length(text) > 100").collect()]
    items = [(i, " ".join(t.split()[k:k + 25]).upper()) for i, (t, k) in enumerate(zip(texts, (0, 3, 9, 1, 0, 2), strict=False))]
    items += [(100, "one, TWO!"), (101, "one"), (102, texts[0]), (102, texts[1]), (None, texts[2]), (103, None), (104, ""), (105, "a a a a a a a a a a a a"), (106, "never seen here")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    found = decontaminate.leak_report(docs, benchmark).collect()
    assert Counter(map(tuple, found)) == Counter(_leaks(docs.collect(), items))
    clean = decontaminate.clean(docs.withColumn("n_words", F.lit("mine")), benchmark).collect()
    assert Counter(r["doc_id"] for r in clean) == Counter(r["doc_id"] for r in found if not r["contaminated"]) and all(r["n_words"] == "mine" for r in clean)


def test_leaks_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leak_report(docs, none).where("contaminated").count() == 0
    assert decontaminate.leak_report(docs, none).count() == docs.count()
    assert decontaminate.leak_report(no_docs, none).count() == 0


def test_fm_index_against_scan():
    draw = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        text = draw.integers(1, 4, n)
        index = decontaminate.FMIndex(text)
        patterns = [text[i:i + k] for i in range(0, n, 7) for k in (1, 2, 5) if i + k <= n] + [np.array([9]), np.array([3, 3, 3, 3, 3])]
        lengths = np.array([len(p) for p in patterns])
        symbols = np.zeros((len(patterns), 5), np.int64)
        for i, p in enumerate(patterns):
            symbols[i, :len(p)] = p
        low, high = index.search(symbols, lengths)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(n - len(p) + 1) if (text[i:i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def _vectors():
    draw = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for _ in range(30):
            base = draw.standard_normal(16)
            rows += [(base + draw.standard_normal(16) * s, label) for s in (0, 0.05, 0.1, 0.2)]
    rows = [(i, [float(np.float32(v)) for v in x], label) for i, (x, label) in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(1000 + i, x, 0) for i, x in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], 1), (2002, rows[0][1], 0), (5, rows[5][1], rows[5][2]), (None, rows[9][1], rows[9][2]), (2003, [1.0, 2.0], 0), (2004, [2.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize("block", [2048, 5])
def test_embedding_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "FILED", 10)
    rows = _vectors()

    def linked(i, j):
        (_, x, a), (_, y, b) = rows[i], rows[j]
        good = lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
        if a is None or a != b or not good(x) or not good(y) or len(x) != len(y):
            return False
        x, y = np.array(x), np.array(y)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    links = [[j for j in range(len(rows)) if j != i and linked(i, j)] for i in range(len(rows))]
    found = embeddings.near_groups(spark.createDataFrame(rows, VECTORS).withColumn("valid", F.lit("mine"))).collect()
    assert Counter(r["vec_id"] for r in found) == Counter(r[0] for r in rows)
    total = sum(map(len, links))
    assert 0.9 * total <= sum(r["n_links"] for r in found) <= total
    by = {r["vec_id"]: r for r in found}
    assert all(by[r[0]]["n_links"] <= len(links[i]) for i, r in enumerate(rows) if r[0] not in (5, None))
    exact = embeddings.near_groups(spark.createDataFrame(rows, VECTORS), recall=1.0).collect()
    group = _groups(len(rows), lambda i, j: j in links[i])
    least = [min(rows[j][0] for j in range(len(rows)) if group[j] == g and rows[j][0] is not None) for g in group]
    want = Counter((r[0], len(links[i]), least[i]) for i, r in enumerate(rows))
    assert sum((Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in exact) & want).values()) >= 0.97 * len(rows)


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embeddings.near_groups(none).count() == 0
    one = spark.createDataFrame([(3, [1.0, 0.0], 1)], VECTORS)
    assert [tuple(r) for r in embeddings.near_groups(one).collect()] == [(3, 0, 3, True)]


def test_multi_sequence_is_sorted_and_whole():
    draw = np.random.default_rng(1)
    left, right = draw.random(6), draw.random(5)
    cells = list(embeddings.multi_sequence(left, right, 1.1))
    far = [left[i] + right[j] for i, j in cells]
    assert far == sorted(far) and set(cells) == {(i, j) for i in range(6) for j in range(5) if left[i] + right[j] <= 1.1}


def _removed(rows, window):
    seen, out = Counter(), []
    lines = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    for words in lines:
        seen.update(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    for r, words in zip(rows, lines, strict=True):
        gone = {k for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1 for k in range(i, i + window)}
        out.append((r["doc_id"], len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window, kmer", [(35, 8), (12, 3), (5, 5)])
def test_repeated_passages(docs, window, kmer):
    found = substrings.remove_repeats(docs.withColumn("start", F.lit("mine")), window, kmer)
    assert Counter(map(tuple, found.collect())) == _removed(docs.collect(), window)


def test_repeats_in_dense_text(spark):
    """Few words, so that windows repeat inside a text, overlap and branch."""
    draw = random.Random(9)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 300))) for _ in range(25)] + ["a " * n for n in (7, 8, 9, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for window, kmer in ((12, 4), (8, 3)):
        assert Counter(map(tuple, substrings.remove_repeats(df, window, kmer).collect())) == _removed(df.collect(), window)


def test_no_passages(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


def test_repeated_rows_report_their_spans_once(spark):
    """Thousands of equal rows cost as much as their texts, and all of their words go."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    kept = substrings.remove_repeats(rows)
    assert kept.groupBy("n_words", "n_removed", "kept").count().collect()[0].asDict() == {"n_words": 300, "n_removed": 300, "kept": "", "count": 4000}
    spans = substrings.repeated_windows(rows).distinct().count()
    assert spans < 60
