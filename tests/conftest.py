import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodesieve.session import local_session  # noqa: E402

RECORDS = "source string, file string, line int, text string, mtime_ms bigint, size_bytes bigint"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="6g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def records(spark):
    def make(*texts, file="f"):
        rows = [("s", file, i + 1, t, 0, len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, RECORDS)

    return make
