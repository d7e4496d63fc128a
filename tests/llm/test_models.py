"""The two classifiers, by held-out accuracy, and the pipeline."""

import random
import zlib

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from lodesieve.llm import quality, toxicity
from lodesieve.llm.common import saved

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(8)
    words = [a + b + c for a in ("ka", "lo", "mi") for b in ("ne", "ru", "so") for c in ("b", "ds", "l")]
    rows, labels = [], []
    for i in range(1500):
        text = [draw.choice(words) for _ in range(draw.randint(15, 80))]
        good, toxic = draw.random() > 0.3, draw.random() < 0.15
        if not good:
            text = [w.upper() + "!!" for w in text] if draw.random() < 0.5 else [text[0]] * len(text)
        if toxic:
            text.insert(draw.randint(0, len(text)), draw.choice(["grubface", "dimwitling", "vexer" + draw.choice(words)]))
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s1", 0), rows[4], (None, "no id", "en", None, 0), (5002, "kane " * 30000, "en", "s2", 0)]
    labels += [(4, 1, None), (None, 1, 1), (9999, 0, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def _accuracy(out, labels, column, modulus, remainder):
    truth = {x[0]: x[column] for x in labels if x[0] is not None}
    rows = [r for r in out if r["doc_id"] in truth and truth[r["doc_id"]] is not None]
    for r in out:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    out = quality.score_quality(docs.withColumnRenamed("n_chars", "stats"), labels).collect()
    assert len(out) == docs.count() and _accuracy(out, truth, 1, 4, 2) > 0.97


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    out = toxicity.score_toxicity(docs.withColumnRenamed("n_chars", "y"), labels).collect()
    assert len(out) == docs.count() and _accuracy(out, truth, 2, 3, 1) > 0.97


def test_held_out_labels_are_not_read(spark, labelled):
    docs, labels, truth = labelled
    for score, modulus, remainder in ((quality.score_quality, 4, 2), (toxicity.score_toxicity, 3, 1)):
        seen = [x for x in truth if x[0] is None or zlib.crc32(str(x[0]).encode()) % modulus != remainder]
        fewer = spark.createDataFrame(seen, labels.schema)
        a, b = ({r["doc_id"]: r["score"] for r in score(docs, some).collect()} for some in (labels, fewer))
        assert a == pytest.approx(b, abs=1e-6)


def test_without_labels_or_documents(spark, labelled, no_docs):
    docs, labels, _ = labelled
    none = labels.limit(0)
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert not any(r["predicted"] for r in toxicity.score_toxicity(docs, none).collect())
    assert quality.score_quality(no_docs, labels).count() == toxicity.score_toxicity(no_docs, labels).count() == 0


def test_pooling():
    import numpy as np

    assert quality.pooled(np.array([1.0, 0.0, 2.0]), np.array([1.0, 3.0, 1.0])).tolist() == [0.25, 0.25, 2.0]


def test_pipeline_stages(spark, labelled, no_docs, tmp_path):
    docs, labels, truth = labelled
    leak = "kanel lorub misods kaneb lonel misol karub lorul minel kasol"
    docs = docs.union(spark.createDataFrame([(6000, f"kaneb {leak} misol", "en", "s1", 0)], DOCS))
    for table, name in ((docs, "documents"), (labels, "labels"), (spark.createDataFrame([(1, leak)], "item_id bigint, text string"), "benchmark")):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    now, held = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, str(tmp_path)))
        held[name] = now
    toxic = {x[0] for x in truth if x[2] == 1}
    ids = {name: [r[0] for r in df.select("doc_id").collect()] for name, df in held.items()}
    assert len(toxic & set(ids["toxicity"])) < 0.05 * len(toxic) and len(ids["toxicity"]) > 0.8 * docs.count()
    assert len(ids["simhash"]) == len(set(ids["simhash"])) < len(ids["toxicity"])
    assert 6000 in ids["simhash"] and set(ids["simhash"]) - set(ids["decontamination"]) == {6000}
    assert max(map(ids["mixing"].count, set(ids["mixing"]))) in (1, 2, 3) and sorted(ids["sharding"], key=str) == sorted(ids["mixing"], key=str)
    assert all(held[n].columns == docs.columns for n in ids if n != "sharding") and held["sharding"].columns == [*docs.columns, "shard", "slot"]
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, run)) == sorted(map(str, held["sharding"].collect()))
    now = no_docs
    for _, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, str(tmp_path)))
    assert now.count() == 0


@pytest.mark.parametrize("n_labels", [4, 30])
def test_few_labels_do_not_empty_the_corpus(spark, n_labels):
    """Labels on few of many documents: nothing is learnt from four, and thirty reject toxic texts at most."""
    words = F.array(*[F.lit(w) for w in ("river", "stone", "window", "letter", "garden", "market", "silver", "morning")])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)) + 1).cast("int"))
    clean = F.concat_ws(" ", *[pick(k) for k in range(30)])
    text = F.when(F.col("id") % 2 == 1, F.concat(clean, F.lit(" you vile scum go rot "), clean)).otherwise(clean)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, text).otherwise(clean).alias("text")).repartition(4)
    docs = docs.union(docs.where("doc_id = 3"))
    known = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:n_labels]
    labels = spark.createDataFrame([(i, i % 2) for i in known], "doc_id bigint, toxic int")
    found = toxicity.score_toxicity(docs, labels)
    wrong = found.where("predicted = 1 and (doc_id >= 600 or doc_id % 2 = 0)").count()
    assert wrong == 0 and found.count() == 12_001
    if n_labels == 4:
        assert found.where("predicted = 1").count() == 0


def test_quality_fit_equals_one_machine(spark, labelled):
    """The sums of the partitions give the ridge weights and the calibration that all rows in one place give."""
    import numpy as np

    docs, labels, truth = labelled
    known = {x[0]: x[1] for x in truth if x[0] is not None and x[1] is not None and zlib.crc32(str(x[0]).encode()) % 4 != 2}
    rows = docs.select("doc_id", "text").collect()
    stats = np.array([quality.statistics(r["text"]) for r in rows])
    model = quality.Model(stats.mean(axis=0), stats.std(axis=0))
    picked = [i for i, r in enumerate(rows) if r["doc_id"] in known]
    z, y = model.features(stats[picked]), np.array([known[rows[i]["doc_id"]] for i in picked], float)
    model.weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    ridge = model.ridge(stats[picked])
    at = np.clip(np.floor((ridge + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1).astype(int)
    full = np.unique(at)
    n, mean, good = (np.array([f(at == b) for b in full]) for f in (np.sum, lambda m: ridge[m].mean(), lambda m: y[m].mean()))
    model.curve = (mean, quality.pooled(good, n.astype(float)))
    want = sorted(zip((str(r["doc_id"]) for r in rows), model.score(stats)))
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.score_quality(docs, labels).collect())
    assert [x[0] for x in got] == [x[0] for x in want] and np.abs(np.array([x[1] for x in got]) - [x[1] for x in want]).max() < 0.02
