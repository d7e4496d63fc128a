"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``max(SHORTEST, COPIES * q)`` that no neighbouring word extends keeping the period. Each of its words occurs ``COPIES``
times in it or more, so a word that is rarer within its segment is in no run: it splits the segment. The pieces are counted
anew until no word is too rare; ordinary prose is gone after a few rounds.

Surviving segments are scanned lag by lag. A run of period q has three multiples of q in a row at which the word equals the
word q further on, so a lag is probed at its multiples only, n/q probes for lag q; the stretch around such a spot is then
opened word by word. Lags rise, and spots inside a known run are passed over: by the theorem of Fine and Wilf no run of
longer period can reach so far into it, thus each run is found once, under its smallest period.

A document is one unit of work, rows are spread as the table is. Null, empty and blank texts have no words and no runs.
Repeated rows are each judged. Texts of any length are taken whole, in memory that grows with the one text. Other columns of
docs are carried by ``collapsed`` alone, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COPIES = 4       # of a period in a run, at least
SHORTEST = 6     # words of a run, at least
_STEP = 64       # words compared at once, at first, when a stretch is opened

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered_words(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers, in order of appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches [start, stop) within which every word occurs often enough, after splitting to stability."""
    done: list[tuple[int, int]] = []
    start, stop = np.array([0]), np.array([len(ids)])
    values = int(ids.max(initial=0)) + 1
    while True:
        long = stop - start >= SHORTEST
        start, stop = start[long], stop[long]
        if not len(start):
            return sorted(done)
        length = stop - start
        of = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(of)) + np.repeat(start - (np.cumsum(length) - length), length)
        _, word, count = np.unique(of * values + ids[at], return_inverse=True, return_counts=True)
        often = count[word] >= COPIES
        split = np.zeros(len(start), bool)
        split[of[~often]] = True
        done += zip(start[~split].tolist(), stop[~split].tolist(), strict=True)
        live = often & split[of]
        same = np.zeros(len(of) + 1, bool)  # this word and the one before are in one piece
        same[1:-1] = live[1:] & live[:-1] & (of[1:] == of[:-1])
        start, stop = at[live & ~same[:-1]], at[live & ~same[1:]] + 1


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree."""
    done, step = 0, _STEP
    while done < len(a):
        differ = a[done:done + step] != b[done:done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, step * 2
    return len(a)


def _scanned(x: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment, whose first word has the number shift."""
    found = []
    reach = np.zeros(len(x), np.int64)  # the furthest end of a known run that holds the word
    for lag in range(1, len(x) // COPIES + 1):
        probes = x[::lag]
        equal = probes[1:] == probes[:-1]
        spots = np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2]) * lag
        for spot in spots[reach[spots] <= spots + 3 * lag].tolist() if len(spots) else ():
            if reach[spot] > spot + 3 * lag:
                continue
            right = spot + _equal(x[spot:len(x) - lag], x[spot + lag:])
            left = spot - _equal(x[:spot][::-1], x[lag:spot + lag][::-1])
            stop = right + lag
            if stop - left >= max(SHORTEST, COPIES * lag):
                found.append((shift + left, stop - left, lag))
                np.maximum(reach[left:stop], stop, out=reach[left:stop])
    return found


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period."""
    return sorted((run for a, b in segments(ids) for run in _scanned(ids[a:b], a)), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, of equal ones that with the least start, then period."""
    best = None
    for run in runs:  # by start, then period, so only a greater one takes over
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    start, length, period = np.array(runs, np.int64).T
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _structs(runs: list[tuple[int, int, int] | None]) -> pa.Array:
    table = np.array([r or (0, 0, 0) for r in runs], np.int64).reshape(-1, 3)
    none = pa.array([r is None for r in runs], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(_ARROW_RUN), mask=none)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) for each row of docs.

    runs are by start, then period; strongest is null without runs; collapsed joins the kept words by one space.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    made_of = T.StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, strongest {RUN}, raw binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, best, texts = [], [], [], []
            for raw in batch.column(1):
                words = (raw.as_py() or b"").split()
                runs = runs_of(numbered_words(words))
                sizes.append(len(words))
                found.append(runs)
                best.append(strongest(runs))
                texts.append(b" ".join(kept_words(words, runs)))
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, _structs([r for runs in found for r in runs]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists, _structs(best), pa.array(texts, pa.binary())],
                                             names=["doc_id", "n_words", "runs", "strongest", "raw"])

    made = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *made_of.fields]))
    return made.withColumn("collapsed", F.col("raw").cast("string")).drop("raw")


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with each text reduced to its kept words; texts without runs, nulls included, stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    # The text rides along as a part of the id, so that rows need not be joined again.
    rows = docs.select(F.struct("text", F.struct(*others, F.lit(0)).alias("others")).alias("doc_id"), "text")
    found = find_runs(rows)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc_id.text"))
    return found.select(*((text if c == "text" else F.col(f"doc_id.others.`{c}`")).alias(c) for c in docs.columns))
