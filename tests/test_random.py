"""Random inputs against plain Python."""

import base64
import random
import re

from pyspark.sql import functions as F

from lodesieve.catalog.rules import DEFAULT_RULES
from lodesieve.functions.text import fingerprint, redact
from lodesieve.operators.boundary import content_of, straddling
from lodesieve.operators.decode import DECODE_GATE, decoded_texts

from test_extract import sample


def plain_candidates(text):
    out, current, end, joinable = [], None, 0, False
    for m in re.finditer(r"[A-Za-z0-9+/=_-]+", text):
        clean = joinable and not text[end:m.start()].strip("\r\n")
        end, joinable = m.end(), len(m[0]) >= 4
        if not joinable:
            continue
        for i, part in enumerate(re.findall(r"[^=]*=+|[^=]+$", m[0])):
            if i == 0 and current is not None and clean:
                current.append(part)
            else:
                out.append(current)
                current = [part]
            if part.endswith("="):
                out.append(current)
                current = None
    out.append(current)
    return [c for c in out if c and sum(map(len, c)) >= 24]


def plain_decode(encoded):
    standard = encoded.replace("-", "+").replace("_", "/").rstrip("=")
    if len(encoded) < 24 or "=" in standard or len(standard) % 4 == 1:
        return None
    raw = base64.b64decode(standard + "=" * (-len(standard) % 4))
    printable = sum(b in (9, 10, 13) or 32 <= b <= 126 for b in raw)
    if not raw or base64.b64encode(raw).decode().rstrip("=") != standard or printable / len(raw) < 0.85:
        return None
    return raw.decode("utf-8", "replace")


def plain_texts(line):
    out = []
    for chunks in plain_candidates(line.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t")):
        tries = [chunks] + ([chunks[1:], chunks[:-1]] if len(chunks) > 1 else [])
        text = next((t for t in (plain_decode("".join(c)) for c in tries) if t is not None), None)
        if text is not None:
            out.append(text)
    return out


def test_decoding_equals_a_plain_decoder(spark):
    rng = random.Random(17)
    words = "the quick brown fox, jumps over: lazy dogs! and (then) some more text 0123456789".split(" ")

    def encoded():
        b = base64.b64encode(" ".join(rng.choices(words, k=rng.randint(2, 14))).encode()).decode()
        b = b if rng.random() < 0.6 else b.rstrip("=")
        b = b if rng.random() < 0.7 else b.replace("+", "-").replace("/", "_")
        if rng.random() < 0.5:
            step, cut = rng.randint(4, 30), rng.choice(["\\n", "\\r\\n", "\n", "\\t"])
            b = cut.join(b[i:i + step] for i in range(0, len(b), step))
        return b

    pieces = [lambda: rng.choice(words), encoded, encoded, lambda: rng.choice(["=", "==", "a=", "KEY=", "====", "\\n", "\n", " ", "ab", "x=y", '"', "===="])]
    lines = ["".join(rng.choice(pieces)() + rng.choice(["", "", " ", "\\n", "\n"]) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, text string")
    rows = df.select("i", decoded_texts(F.col("text")).getField("text").alias("d"), F.col("text").rlike(DECODE_GATE).alias("gate")).collect()
    got = {r.i: r.d for r in rows}
    assert all(r.gate for r in rows if r.d)
    wrong = [(line, got[i], plain_texts(line)) for i, line in enumerate(lines) if got[i] != plain_texts(line)]
    assert sum(bool(v) for v in got.values()) > 500
    assert not wrong, wrong[:3]


def plain_straddles(tail, head):
    joined, seam, out = tail + head, len(tail), []
    for r in DEFAULT_RULES:
        rx = re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0))
        left = {m.start() for m in rx.finditer(tail) if m.end() == seam}
        right = {seam + m.end() for m in rx.finditer(head) if m.start() == 0}
        for m in rx.finditer(joined):
            if m.start() <= seam - 4 and m.end() >= seam + 4 and m.start() not in left and m.end() not in right:
                out.append((r.id, m[0]))
    return sorted(out)


def test_seams_equal_a_plain_matcher(spark):
    rng = random.Random(23)
    rows = []
    for i in range(1200):
        v = sample(rng.choice(DEFAULT_RULES).id, "s" * rng.randint(1, 9))
        text = rng.choice(["", "x ", 'k="', "word=", "é"]) + v + rng.choice(["", " y", '"', "zz", " " + v])
        cut = rng.randint(0, len(text))
        rows.append(("s", str(i), 1, 0, text[:cut][-300:], text[cut:][:300]))
    df = spark.createDataFrame(rows, "source string, file string, line int, mtime_ms bigint, tail string, head string")
    got = {}
    for r in straddling(df).collect():
        got.setdefault(r.file, []).append((r.rule_id, r.value))
    for _, f, _, _, tail, head in rows:
        want = plain_straddles(tail, head) if tail and head else []
        assert sorted(got.get(f, [])) == want, (tail, head)
    assert len(got) > 300


def test_content_masks_and_identity(spark):
    rng = random.Random(29)
    alphabet = ['"', "\\", "{", "}", "a", "é", " ", "😀", ":"]
    lines = [rng.choice(["{", "[", "", " {"]) + "".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(800)]

    def longest(line):
        if line.strip()[:1] not in ("{", "["):
            return line
        found = [m[1] for m in re.finditer(r'"((?:[^"\\]|\\.?)*)(?:"|$)', line, re.DOTALL)]
        best = max(found, key=len, default="")
        return best if len(best) >= 24 else line

    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    rows = df.select("i", "t", content_of(F.col("t")).alias("c"), redact(F.col("t")).alias("p"),
                     fingerprint(F.lit("r"), redact(F.col("t")), F.lit("f")).alias("fp")).collect()
    for r in rows:
        assert r.c == longest(r.t)
        assert len(r.t) <= 10 or r.p != r.t
        assert re.fullmatch(r"rf1-[0-9a-f]{32}", r.fp)
