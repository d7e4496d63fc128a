"""Token counts by a finite-state transducer that is compiled from a byte-fallback BPE model.

The last token of a BPE encoding of a prefix is found from the last tokens of shorter prefixes: token t may follow token s
exactly if the pair s, t encodes to itself, that is if no join crosses between a part at the right edge of s and one at the
left edge of t. So the transducer's state is, for every suffix of the read text that begins some piece: (trie node, the
parts at the right edge of the token before it that can still matter, tokens before it less tokens so far). Each transition
carries the change of the token count. Only suffixes inside the trie matter, hence the states are finite; they are compiled
when first met, like those of a lazy DFA, and dropped together when there are too many.

No piece of the model goes on after a blank that follows a letter, so reading a blank there always leads to the same state.
A text is cut into chunks anywhere; the map of a chunk sends an entry state to an exit state and a count. It is the part
before its first such blank, kept to be run from the entry state, and a constant count and exit after it. Two neighbouring
maps compose to one of the same form, in any grouping, so the maps of a long text meet in a parallel prefix tree: ``FAN_IN``
neighbours a round, as rows that Spark spreads, until one map is left. A text of one chunk is counted where it is read.
A stretch without blanks is carried as its own text, which is its map from all entry states in the shortest form.

A null text counts as empty: no token. Repeated rows are counted one by one. Strings of control tokens inside a text are
plain text; no normalisation takes place, and a blank is put in front, as the model says. Other columns play no part,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesieve.llm.common import saved

BLANK = "▁"
CHUNK = 1 << 16        # characters
FAN_IN = 16            # neighbouring maps that are composed in one round
LIMIT = 4096           # tokens; longer documents are marked
MAX_STATES = 300_000   # compiled ones that a worker holds
MAX_WORDS = 400_000    # whose transitions a worker holds


class _State(dict):
    """Transitions by character: (next state, change of the count)."""

    __slots__ = ("live", "owner")

    def __init__(self, owner: Transducer, live: tuple):
        self.owner, self.live = owner, live

    def __missing__(self, char: str):
        self[char] = made = self.owner.step(self.live, char)
        return made


class Transducer:
    """Counts tokens of text whose blanks are written as ``▁``."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {piece[:n] for piece in scores for n in range(1, len(piece) + 1)}
        self.edges: dict[str, tuple[tuple, tuple] | None] = {}
        self.clear()

    @classmethod
    def load(cls, path: str) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.words = _Words(self)
        self.near: dict[tuple, tuple] = {}
        self.start = self.state((("", (), 0),))

    def state(self, live: tuple) -> _State:
        if live not in self.states:
            self.states[live] = _State(self, live)
        return self.states[live]

    def edges_of(self, piece: str) -> tuple[tuple, tuple] | None:
        """The parts of a piece at its left and right edge while BPE joins it, each with the score of the join that ends it.

        None if BPE never makes this piece.
        """
        if piece not in self.edges:
            parts, left, right = list(piece), [], []
            while len(parts) > 1:
                best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
                if best is None:
                    break
                i = -best[1]
                if i == 0:
                    left.append((parts[0], best[0]))
                if i == len(parts) - 2:
                    right.append((parts[-1], best[0]))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            end = (piece, float("-inf"))
            self.edges[piece] = ((*left, end), (*right, end)) if len(parts) == 1 else None
        return self.edges[piece]

    def follows(self, edge: tuple, piece: str) -> bool:
        """Whether no join crosses from a token with this right edge into the piece. Of equal joins the left one is first."""
        edges = self.edges_of(piece)
        if edges is None:
            return False
        scores = self.scores
        for x, x_ends in edge:
            for y, y_ends in edges[0]:
                joined = scores.get(x + y)
                if joined is not None and joined > x_ends and joined >= y_ends:
                    return False
        return True

    def relevant(self, edge: tuple, node: str) -> tuple:
        """The parts of a right edge that can still join with a piece that begins with ``node``."""
        key = (edge, node)
        if key not in self.near:
            scores, keep = self.scores, []
            for x, ends in edge:
                if x + node in self.prefixes or any(scores.get(x + node[:n], ends) > ends for n in range(1, len(node))):
                    keep.append((x, ends))
            self.near[key] = tuple(keep)
        return self.near[key]

    def step(self, live: tuple, char: str) -> tuple[_State, int]:
        grown = [(node + char, edge, count) for node, edge, count in live if not node or node + char in self.prefixes]
        for node, edge, count in grown:
            known = node in self.scores
            if (known or len(node) == 1) and self.follows(edge, node):
                change = count + (1 if known else len(char.encode("utf-8", "surrogatepass")))
                break
        kept = [(other, self.relevant(edge, other) if edge else (), count - change) for other, edge, count in grown if other in self.prefixes]
        return self.state((*kept, ("", self.edges_of(node)[1], 0))), change

    def run(self, state: _State, text: str) -> tuple[_State, int]:
        total = 0
        for char in text:
            state, change = state[char]
            total += change
        return state, total

    def trim(self) -> None:
        """Between texts: forgets what was compiled when it is too much. Words go alone; the states rebuild them soon."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        if len(self.states) > MAX_STATES or len(self.near) > 2 * MAX_STATES:
            self.clear()


class _Words(dict):
    """Counts of whole words, from the state in front of their blank: transitions over many characters at once."""

    __slots__ = ("machine",)

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        self[word] = count = self.machine.run(self.machine.start, word)[1]
        return count


_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*").findall
_LOADED: dict[str, Transducer] = {}


def _transducer(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer.load(path)
    _LOADED[path].trim()
    return _LOADED[path]


def boundary(text: str) -> int:
    """The first blank that follows another character of the text, or -1: there the state no longer depends on the entry."""
    at = text.find(BLANK)
    while at == 0 or (at > 0 and text[at - 1] == BLANK):
        at = text.find(BLANK, at + 1)
    return at


def chunk_map(machine: Transducer, text: str, first: bool) -> tuple[str, int, str | None]:
    """(head, count, tail): run head from the entry state; then, if tail is not null, add count and run tail from the start."""
    cut = 0 if first else boundary(text)
    if cut < 0:
        return text, 0, None
    last = text.rfind(BLANK)
    while last > cut and text[last - 1] == BLANK:
        last -= 1
    last = max(last, cut)
    return text[:cut], sum(map(machine.words.__getitem__, _UNITS(text, cut, last))), text[last:]


def joined(machine: Transducer, maps: list[tuple[str, int, str | None]]) -> tuple[str, int, str | None]:
    """The map of neighbouring chunks, in order."""
    head, count, tail = "", 0, None
    for h, c, t in maps:
        if tail is None:
            head, count, tail = head + h, c, t
        elif t is None:
            tail += h
        else:
            state, first = machine.run(machine.start, tail)
            count += first + machine.run(state, h)[1] + c
            tail = t
    return head, count, tail


def total(machine: Transducer, whole: tuple[str, int, str | None]) -> int:
    """The count of a whole text; what stands before its first blank is run from the start."""
    head, count, tail = whole
    return machine.run(machine.start, head)[1] + count + (0 if tail is None else machine.run(machine.start, tail)[1])


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; model: path of a sentencepiece BPE model on every node."""
    ready = F.translate(F.concat(F.lit(BLANK), F.col("text")), " ", BLANK)
    length = F.length(ready)
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), length - 1, F.lit(chunk))).otherwise(F.array(F.lit(0)))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       F.when(F.length("text") > 0, ready).otherwise("").alias("text"), starts.alias("starts"))
    one = F.posexplode(F.transform("starts", lambda s: F.substr(F.col("text"), s + 1, F.lit(chunk))))
    chunks = rows.select("doc_id", "row", "n_bytes", F.size("starts").alias("chunks"), one.alias("at", "part"))
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, at, part in zip(batch.column("chunks").to_pylist(), batch.column("at").to_pylist(), batch.column("part"), strict=True):
                machine = _transducer(model)
                own = chunk_map(machine, part.as_py(), at == 0)
                found.append((total(machine, own), None, None, None) if n == 1 else (None, *own))
            tokens, heads, counts, tails = zip(*found, strict=True) if found else ((), (), (), ())
            made = [pa.array(x, k) for x, k in ((tokens, pa.int64()), (heads, pa.string()), (counts, pa.int64()), (tails, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=["doc_id", "row", "n_bytes", "chunks", "at", "n_tokens", "head", "count", "tail"])

    # Saved, so that a row number is that of one evaluation.
    mapped = saved(chunks.mapInArrow(maps, f"doc_id {kind}, row bigint, n_bytes bigint, chunks int, at int, n_tokens bigint, head string, count bigint, tail string"))
    done = mapped.where("chunks = 1").select("doc_id", "n_bytes", "n_tokens")
    now = mapped.where("chunks > 1").select("doc_id", "row", "n_bytes", "at", F.struct("head", "count", "tail").alias("map"))
    longest = mapped.agg(F.max("chunks")).first()[0] or 1

    def read(column: pd.Series) -> list:
        return [[(m["head"], m["count"], m["tail"]) for m in some] for some in column]

    @F.pandas_udf("head string, count bigint, tail string")
    def compose(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([joined(_transducer(model), some) for some in read(column)], columns=["head", "count", "tail"]).astype({"count": "int64"})

    @F.pandas_udf("bigint")
    def finish(column: pd.Series) -> pd.Series:
        return pd.Series([total(_transducer(model), joined(_transducer(model), some)) for some in read(column)], dtype="int64")

    while longest > 1:
        grouped = now.groupBy("row", F.floor(F.col("at") / fan_in).cast("int").alias("at")).agg(
            F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.transform(F.array_sort(F.collect_list(F.struct("at", "map"))), lambda x: x["map"]).alias("maps"))
        longest = -(-longest // fan_in)
        if longest > 1:
            now = saved(grouped.select("doc_id", "row", "n_bytes", "at", compose("maps").alias("map")))
        else:
            done = done.union(grouped.select("doc_id", "n_bytes", finish("maps").alias("n_tokens")))
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
