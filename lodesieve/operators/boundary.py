"""Values split over two neighbouring records of one file.

The pair (n, n+1) is looked at through two windows, the end of n and the start of n+1.
The rules' patterns say how far a match can reach (see ``functions.reach``), so the
windows are a few words, or one word of any length, and no split value is cut off.

Records meet in blocks of ``BLOCK_LINES`` lines of a file; the first record of a block
also stands at the end of the block before.  One shuffle of the windows brings a block
together, and one huge file is spread over all tasks.  Where a whole file is one row,
``seam_array`` pairs its lines inside the row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodesieve.catalog.rules import DEFAULT_RULES, Rule
from lodesieve.functions.reach import beginning_of, ending_of
from lodesieve.functions.regex import SPACE
from lodesieve.functions.text import bind
from lodesieve.operators.extract import explode_hits, hit, holds, located_matches, passes_gate, rule_table

# Shortest content and shortest share of a value on one side.
MIN_CONTENT = 24
WHOLE = 1 << 30  # a width that holds every seam
MIN_SHARE = 4
BLOCK_LINES = 1024  # of a file, paired in one group

# Possessive on purpose: a repeated alternative would overflow the regex stack on long lines.
_JSON_STRING = r'"((?:[^"\\]++|\\[\s\S]?+)*+)(?:"|\z)'


def content_of(text: Column) -> Column:
    """The longest JSON string of a JSON line, otherwise the line itself."""
    strings = F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(1))
    longest = F.array_max(F.transform(strings, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))
    is_json = text.rlike(rf"\A[{SPACE}]*+[\[{{]")
    return F.when(is_json, bind(longest, lambda s: F.when(s["n"] >= MIN_CONTENT, s["s"]).otherwise(text))).otherwise(text)


def with_content(records: DataFrame) -> DataFrame:
    """Add ``content``, the part of a record a value is continued from or into."""
    return records.withColumn("content", content_of(F.col("text")))


def seam_windows(content: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """``(tail, head)``: what a value could begin with at the end of a record, and end with at its start."""
    return bind(content, lambda c: F.struct(beginning_of(c, rules).alias("tail"), ending_of(c, rules).alias("head")))


def windowed(records: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Records without their text, as ``tail`` and ``head``; those that can be part of no split value are left out."""
    both = seam_windows(content_of(F.col("text")), rules)
    filled = records.where((F.length("text") > 0) & F.col("line").isNotNull())
    rows = filled.select(*[c for c in records.columns if c not in ("text", "tail", "head", "size_bytes")], F.explode(F.array(both)).alias("w")).select("*", "w.*").drop("w")
    return rows.where((F.length("tail") >= MIN_SHARE) | (F.length("head") >= MIN_SHARE))


def in_blocks(rows: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Add ``block``; the first row of a block also comes last in the block before."""
    own = F.floor(F.col("line") / lines)
    return rows.withColumn("block", F.explode(F.when(F.col("line") % lines == 0, F.array(own - 1, own)).otherwise(F.array(own))))


def record_seams(records: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Seams between neighbouring, non-blank records.

    ``line`` is the first record's; ``tail`` and ``head`` are the two windows.
    """
    following = Window.partitionBy("source", "file", "block").orderBy("line").rangeBetween(1, 1)
    rows = in_blocks(windowed(records, rules).select("source", "file", "line", "mtime_ms", "tail", "head"))
    paired = rows.select("source", "file", "line", "mtime_ms", "tail", F.collect_list("head").over(following).alias("heads"))
    return paired.select("source", "file", "line", "mtime_ms", "tail", F.explode("heads").alias("head"))


def seam_array(lines: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Array of ``(tail, head)`` of each line and the one after it; NULL where either is blank or missing."""
    def pairs(windows: Column) -> Column:
        following = F.slice(windows, F.lit(2), F.greatest(F.size(windows) - 1, F.lit(0)))
        return F.zip_with(windows, following, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(
            a["tail"].alias("tail"), b["head"].alias("head"))))

    def windows(t: Column, i: Column) -> Column:
        # A window is only taken where the line has a neighbour on that side.
        before, after = F.length(F.get(lines, i - 1)) > 0, F.length(F.get(lines, i + 1)) > 0
        both = bind(content_of(t), lambda c: F.struct(
            F.when(after, beginning_of(c, rules)).alias("tail"), F.when(before, ending_of(c, rules)).alias("head")))
        return F.when((F.length(t) > 0) & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))), both)

    return bind(F.transform(lines, windows), pairs)


def seam_gate(tail: Column, head: Column, rules: tuple[Rule, ...]) -> Column:
    """May any rule match over the seam?

    Matches of token rules hold no blank, so only the word that crosses the seam
    matters to them; the few other rules look at both windows.
    """
    tokens = tuple(r for r in rules if r.token)
    others = tuple(r for r in rules if not r.token)
    word = F.concat(F.substring_index(tail, " ", -1), F.substring_index(head, " ", 1))
    gate = F.lit(False)
    if tokens:
        gate = gate | ((F.length(word) >= 2 * MIN_SHARE) & passes_gate(word, tokens))
    if others:
        gate = gate | passes_gate(F.concat(tail, head), others)
    return gate


def seam_hits(tail: Column, head: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Array of hits over the seam, at most one per rule.

    A match is discarded when the rule already matches completely on one side,
    flush with the seam: then the other side only happened to continue it with
    allowed characters.
    """
    seam = F.length(tail)
    # Wide enough to hold everything before a match, so its length is the offset.
    table = rule_table(rules, width=WHOLE)

    def flush(m: Column) -> Column:
        values, gaps = (F.regexp_extract_all(tail, m[r], F.lit(g)) for r, g in (("regex", 0), ("gap_regex", 1)))
        # Only the last match can end at the seam; what is in front of it starts it.
        covered = F.aggregate(F.concat(values, gaps), F.lit(0), lambda acc, p: acc + F.length(p))
        last = F.length(F.get(values, F.size(values) - 1))
        ends_at_seam = (covered == seam) & (covered - last == m["start"])
        first_in_head = F.get(F.regexp_extract_all(head, m["regex"], F.lit(0)), 0)
        at_front = F.get(F.regexp_extract_all(head, m["gap_regex"], F.lit(1)), 0) == ""
        starts_at_seam = at_front & (seam + F.length(first_in_head) == m["start"] + F.length(m["value"]))
        return F.coalesce(ends_at_seam, F.lit(False)) | F.coalesce(starts_at_seam, F.lit(False))

    def crossing(joined: Column) -> Column:
        located = located_matches(joined, rules, table, lambda r, v, b: F.struct(
            r["rule_id"].alias("rule_id"), r["label"].alias("label"), r["confidence"].alias("confidence"),
            v.alias("value"), F.length(b).alias("start"), r["regex"].alias("regex"), r["gap_regex"].alias("gap_regex")))
        over = F.filter(located, lambda m: (seam - m["start"] >= MIN_SHARE)
                        & (m["start"] + F.length(m["value"]) - seam >= MIN_SHARE))
        kept = F.filter(over, lambda m: ~flush(m))
        if any(r.validate is not None for r in rules):
            kept = F.filter(kept, lambda m: holds(m["rule_id"], m["value"], rules))
        return F.transform(kept, lambda m: hit(m["rule_id"], m["label"], m["confidence"], m["value"], "boundary"))

    return F.when(seam_gate(tail, head, rules), bind(F.concat(tail, head), crossing))


def straddling(seams: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Matches over a seam, one row per seam and rule."""
    gated = seams.where(seam_gate(F.col("tail"), F.col("head"), rules))
    return explode_hits(gated, seam_hits(F.col("tail"), F.col("head"), rules))


def scan_boundary(records: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Values split over two neighbouring records; one row per split value."""
    return straddling(record_seams(records, rules), rules)


def both_lines(matches: DataFrame) -> DataFrame:
    """Report a split value on both of its lines, with ``span_lines``."""
    split = F.col("pass") == "boundary"
    span = F.when(split, F.array("line", F.col("line") + 1))
    kept = [c for c in matches.columns if c != "line"]
    return matches.select(*kept, span.alias("span_lines"),
                          F.explode(F.coalesce(span, F.array("line"))).alias("line"))
