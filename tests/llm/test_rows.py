"""Chat formatting, mixing, sharding, token counts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodesieve.llm import chat, mixing, sharding, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EVENTS = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def _fold(events):
    """Plain replay of a log."""
    convs = defaultdict(dict)
    for conv, _, message, kind, role, text in sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[4] is not None, e[4] or "", e[5] is not None, e[5] or "")):
        if message is None:
            continue
        held = convs[conv]
        if kind == "regenerate":
            for m in [m for m in held if m >= message]:
                del held[m]
        old = held.get(message, ("", ""))[1] if kind not in ("edit", "regenerate") else ""
        held[message] = (role or "", old + (text or ""))
    return {(c, m, *x) for c, held in convs.items() for m, x in held.items()}


def test_events_fold_like_a_replay(spark):
    draw = random.Random(1)
    events = [(draw.randint(0, 3), s, draw.randint(0, 4), draw.choice(["delta", "delta", "delta", "edit", "regenerate", None]), draw.choice(["user", "assistant"]),
               draw.choice(["a", "b<|im_end|>", None, "\\"])) for s in range(200)]
    events += [(None, 1, 1, "delta", None, "x"), (9, 1, None, "delta", "user", "gone"), (8, 1, 1, "regenerate", "user", None)]
    found = chat.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    assert {tuple(r) for r in found} == _fold(events) and len(found) == len(_fold(events))


def test_rendering_reads_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|im_end|>", "<|", "\n\n", "", None, "x<", "|im_end|>", "é😀", "long " * 50000]
    roles = ["user", "assistant", "sys\ntem", "<|im_start|>", None, "\\", "assistant"]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(c * 5 + t) % len(texts)]) for c in range(9) for t in range(len(texts))]
    rows += [(5, 3, "user", "tie"), (5, 3, "user", "tie"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("clash"))
    chats = chat.format_chats(chat.message_events(df))
    found = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    formatted = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    key = lambda x: (x is not None, x if x is not None else "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), key(r[2]), key(r[3])))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        got = found[conv]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (len(own), sha(said), len(loss), sha(loss))
        assert got["formatted_chars"] == len(formatted[conv])
        assert formatted[conv].count("<|im_start|>") == formatted[conv].count("<|im_end|>") == len(own)


def test_chat_of_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_chats(chat.message_events(empty))).count() == 0


def _mixed(rows):
    size = lambda t: len(WORD.findall(t or ""))
    totals = Counter()
    for r in rows:
        totals[r["source"]] += size(r["text"])
    order = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in totals else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(totals.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * totals[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        open_ -= full
    return totals, target


def test_mix_meets_targets(docs):
    rows = docs.collect()
    totals, target = _mixed(rows)
    out = mixing.mix_counts(docs).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        asked = r["target"] / max(1, r["source_size"])
        assert r["copies"] <= 3 and (r["size"] == 0 or abs(r["copies"] - asked) < 1)
        taken[r["source"]] += r["copies"] * r["size"]
    biggest = defaultdict(int)
    for r in out:
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in totals)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_counts(docs.repartition(5)).collect()))


def test_pivotal_rounding_is_unbiased():
    import numpy as np

    draw = np.random.default_rng(1)
    sizes, shares = np.array([5.0, 3.0, 9.0, 2.0]), np.array([0.3, 0.6, 0.45, 0.8])
    total, mean = (sizes * shares).sum(), np.zeros(4)
    for _ in range(4000):
        out = mixing.settle(sizes, shares, draw.random(4))
        assert (sizes * out).sum() == pytest.approx(total) and ((out > 0) & (out < 1)).sum() <= 1
        mean += out / 4000
    assert abs(mean - shares).max() < 0.04


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 7))").alias("text"), F.expr("if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c'))").alias("source"))
    out = mixing.mix_counts(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 7 for r in out)


def test_mix_repeats_rows_and_keeps_clashing_columns(spark, docs, no_docs):
    extra = docs.withColumn("copies", F.lit("mine")).withColumn("key", F.lit("mine")).withColumn("value", F.lit("mine"))
    want = Counter()
    for r in mixing.mix_counts(docs).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.mix(extra).collect()
    assert +want == Counter(r["doc_id"] for r in out) and all(r["copies"] == r["key"] == r["value"] == "mine" for r in out)
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_counts(no_docs).count() == 0


def test_shards_match_the_mixture(docs, no_docs):
    out = sharding.shard_documents(docs.withColumn("slot", F.lit("mine")).withColumn("turn", F.lit("mine")), 7).collect()
    assert Counter(str(r[:5]) for r in out) == Counter(str(r[:5]) for r in docs.collect()) and all(r["turn"] == "mine" for r in out)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
    sources = Counter(r["source"] for r in out)
    for (_, source), n in Counter((r["shard"], r["source"]) for r in out).items():
        assert abs(n - sources[source] / 7) < 3
    assert sharding.shard_documents(no_docs, 7).count() == 0


def test_shard_order_by_brute_force(docs):
    rows = [r for r in docs.dropDuplicates(["doc_id"]).collect()]
    draw = lambda r: hashlib.md5(":".join(["20", *([str(r["doc_id"])] if r["doc_id"] is not None else [])]).encode()).hexdigest()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(draw(r))
    shares = sorted(((i + 0.5) / len(v), s is not None, s or "", d) for s, v in by.items() for i, d in enumerate(sorted(v)))
    want = {d: (k * 5 // len(rows)) for k, (_, _, _, d) in enumerate(shares)}
    out = sharding.shard(docs.dropDuplicates(["doc_id"]).select("doc_id", "source"), 5).collect()
    assert {draw(r): r["shard"] for r in out} == want


def test_crc_matches_zlib(spark):
    text = "é text"
    assert spark.range(1).select(F.crc32(F.lit(text).cast("binary"))).first()[0] == zlib.crc32(text.encode())


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("sentencepiece")
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(docs, no_docs, model):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    for chunk in (3, 1 << 16):
        out = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs, model, chunk=chunk, fan_in=7).collect())
        counts = [(r["doc_id"], len((r["text"] or "").encode()), len(processor.encode(r["text"] or ""))) for r in docs.collect()]
        assert out == Counter((*x, x[2] > 4096) for x in counts)
    assert tokens.count_tokens(no_docs, model).count() == 0


def test_transducer_on_random_text(model):
    import sentencepiece

    processor, machine, draw = sentencepiece.SentencePieceProcessor(model_file=model), tokens.Transducer.load(model), random.Random(3)
    for alphabet in ("ab  \n▁<s>é漢😀01'the\u0000", "aaab ", "abcdefghijklmnopqrstuvwxyzABC     .,", "▁ "):
        for _ in range(1500):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60)))
            ready = "▁" + text.replace(" ", "▁")
            want, size = len(processor.encode(text)), draw.randint(1, 20)
            maps = [tokens.chunk_map(machine, ready[i:i + size], i == 0) for i in range(0, len(ready), size)]
            assert tokens.total(machine, tokens.chunk_map(machine, ready, True)) == want, text
            while len(maps) > 1:  # in any grouping
                at = draw.randrange(len(maps) - 1)
                n = draw.randint(2, 4)
                maps[at:at + n] = [tokens.joined(machine, maps[at:at + n])]
            assert tokens.total(machine, maps[0]) == want, text


def test_mixing_of_repeated_rows(spark):
    """Thousands of equal rows are one class: buckets stay small, copies are dealt out evenly, sources come near their targets."""
    hot = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("a").alias("source"), F.col("id").alias("extra"))
    rest = spark.range(9_000).select("id", F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")), F.when(F.col("id") % 3 == 0, "b").otherwise("a"), F.col("id"))
    docs = hot.union(rest).repartition(6)
    classes = mixing.class_copies(mixing.words_of(docs))
    assert classes.count() == 9_001 and classes.agg(F.sum("n")).first()[0] == 29_000
    counts = mixing.mix_counts(docs)
    assert counts.count() == 29_000 and counts.where("copies > 3").count() == 0
    spread = counts.where("doc_id is null").agg(F.min("copies"), F.max("copies")).first()
    assert spread[1] - spread[0] <= 1
    for r in counts.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 40
    mixed = mixing.mix(docs)
    key = lambda df: sorted((str(r.doc_id), r.source, r.n) for r in df.collect())
    of_mix = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    of_counts = counts.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0")
    assert key(of_mix) == key(of_counts) and mixed.columns == docs.columns
    each = mixed.where("doc_id is null").groupBy("extra").count().agg(F.max("count")).first()[0]
    assert each == spread[1]


def test_tokens_of_long_texts_without_blanks(spark, model):
    """Texts of several chunks, with and without any blank."""
    import sentencepiece

    processor, draw = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(6)
    texts = ["".join(draw.choices("abcdeé漢字", k=150_000)), "x" * 70_000, " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(40_000)),
             "word " * 30_000 + "".join(draw.choices("abc", k=140_000)) + " end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    extra = rows.withColumn("row", F.lit(1)).withColumn("maps", F.lit("mine"))
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(extra, model).collect()} == {i: len(processor.encode(t)) for i, t in enumerate(texts)}
