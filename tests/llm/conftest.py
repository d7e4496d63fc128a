import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of invented words with copies, near copies, shared passages, nulls, empty, long and repeated texts."""
    draw = random.Random(4)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "rü", "so") for b in ("b", "ds", "l", "ng", "r", "st", "x")]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = line(60)
    texts = [line(draw.randint(1, 120)) for _ in range(60)]
    texts += [f"{line(20)} {passage} {line(draw.randint(0, 30))}" for _ in range(8)]
    texts += [texts[3]] * 4 + [texts[5] + " end", texts[5].upper()]
    texts += [None, "", "  \t\n", "one", "one two", "a " * 400, " x y", line(5000)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{'' if i % 2 else i % 5}", 0) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (7, "another text of the same id", "en", "s", 0), (None, "no id", None, "s1", None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
