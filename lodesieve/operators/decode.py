"""Base64 decoding followed by a second look with the high-confidence rules.

A candidate is a run of base64 characters, possibly wrapped over several lines
of text (real line ends or the two-character escapes ``\\n`` and ``\\r``), closed
by padding.  It counts as text only if it is long enough, mostly printable and
encodes back to exactly the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesieve.catalog.rules import HIGH_RULES, Rule
from lodesieve.functions.text import base64_bytes, bind
from lodesieve.operators.extract import explode_hits, passes_gate, rule_hits

# The shortest candidate and its share of printable bytes.  There is no longest one.
MIN_CHARS = 24
PRINTABLE_SHARE = 0.85

_B = r"[\w+/-]"
_B_OR_PAD = r"[\w+/=-]"
# A run that continues after a pure line break, must itself be 4 characters long.
_NEXT_RUN = rf"[\r\n]++(?={_B_OR_PAD}{{4}})"
# A candidate starts with its run or, after padding, inside it; the run as a whole has 4 characters.
_START = (rf"(?:(?<!{_B_OR_PAD})(?={_B_OR_PAD}{{4}})|(?<={_B_OR_PAD}{{2}}=)|(?<={_B_OR_PAD}=)(?={_B_OR_PAD}{{2}})"
          rf"|(?<==)(?={_B_OR_PAD}{{3}}))")
CANDIDATE = (
    rf"{_START}{_B}++"
    rf"(?:=++|(?:{_NEXT_RUN}{_B}++(?!=))*+(?:{_NEXT_RUN}{_B}*+=++)?+)"
)
# No candidate without 24 characters in a row, or a wrapped run.  Only starts of
# runs are tried, so ordinary words are walked once.
DECODE_GATE = rf"(?<!{_B_OR_PAD}){_B_OR_PAD}(?:{_B_OR_PAD}{{{MIN_CHARS - 1}}}|{_B_OR_PAD}*+(?:\\[nr]|[\r\n]))"


def normalize_escapes(text: Column) -> Column:
    """Turn the JSON escapes for line feed, carriage return and tab into the characters."""
    out = F.replace(text, F.lit("\\n"), F.lit("\n"))
    out = F.replace(out, F.lit("\\r"), F.lit("\r"))
    return F.replace(out, F.lit("\\t"), F.lit("\t"))


def decode_to_text(encoded: Column) -> Column:
    """Struct ``(text, encoding)`` of one candidate, NULL if it is not text."""
    encoding = F.when(encoded.rlike("[-_]"), F.lit("base64url")).otherwise(F.lit("base64"))

    def as_text(raw: Column) -> Column:
        printable = F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), r"[^\t\n\r -~]", ""))
        size = F.octet_length(raw)
        is_text = (size > 0) & (printable >= PRINTABLE_SHARE * size)
        return F.when(is_text, F.struct(F.make_valid_utf8(raw.cast("string")).alias("text"), encoding.alias("encoding")))

    return bind(F.when(F.length(encoded) >= MIN_CHARS, base64_bytes(encoded)), as_text)


def decoded_texts(text: Column) -> Column:
    """Array of ``(text, encoding)`` for every candidate of a record.

    A wrapped candidate that does not decode is tried again without its first
    and then without its last line: prose often touches the block.
    """
    candidates = F.filter(F.regexp_extract_all(normalize_escapes(text), F.lit(CANDIDATE), F.lit(0)),
                          lambda c: (F.length(c) >= MIN_CHARS) & (F.length(F.regexp_replace(c, r"[\r\n]", "")) >= MIN_CHARS))

    def attempt(candidate: Column) -> Column:
        joined = F.regexp_replace(candidate, r"[\r\n]", "")
        headless = F.regexp_replace(F.regexp_replace(candidate, r"\A[^\r\n]++[\r\n]++", ""), r"[\r\n]", "")
        tailless = F.regexp_replace(F.regexp_replace(candidate, r"[\r\n]++[^\r\n]*+\z", ""), r"[\r\n]", "")
        wrapped = F.coalesce(decode_to_text(joined), decode_to_text(headless), decode_to_text(tailless))
        return F.when(candidate.rlike(r"[\r\n]"), wrapped).otherwise(decode_to_text(candidate))

    return F.filter(F.transform(candidates, attempt), lambda d: d.isNotNull())


def decoded_hits(text: Column, rules: tuple[Rule, ...] = HIGH_RULES) -> Column:
    """Array of hits inside base64 text; the same rule and value count once per record."""
    def in_text(d: Column) -> Column:
        return F.transform(rule_hits(d["text"], rules, pass_name="decoded"), lambda h: h.withField(
            "encoding", d["encoding"]).withField("before", F.lit(None).cast("string")).withField("confidence", F.lit("high")))

    def first_of_each(hits: Column) -> Column:
        return bind(F.transform(hits, lambda h: F.struct(h["rule_id"], h["value"])), lambda keys: F.filter(
            hits, lambda h, i: F.array_position(keys, F.struct(h["rule_id"], h["value"])) == i + 1))

    readable = F.filter(decoded_texts(text), lambda d: passes_gate(d["text"], rules))
    hits = bind(F.flatten(F.transform(readable, in_text)), first_of_each)
    return F.when(text.rlike(DECODE_GATE), hits)


def scan_decoded(records: DataFrame, rules: tuple[Rule, ...] = HIGH_RULES) -> DataFrame:
    """Matches inside base64 text.

    Records without a long run, and decoded texts without an anchor, never reach
    the rules.
    """
    gated = records.where(F.col("text").rlike(DECODE_GATE))
    return explode_hits(gated, decoded_hits(F.col("text"), rules))
