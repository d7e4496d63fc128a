"""Queries over records and matches, each next to its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.catalog import rules as R
from lodesieve.functions.text import fingerprint, redact
from lodesieve.operators import boundary, decode, extract, images, injection, pairing, pii, plant, suppress
from lodesieve.operators import redact as masking
from lodesieve.plans import scan as plan
from lodesieve.session import checkpointed, shared_folder
from lodesieve.sources import records as src
from lodesieve.workload import base
from lodesieve.workload import oracle as O
from lodesieve.workload.oracle import PLANT_CTES, statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


MATCHES = PLANT_CTES + [("m", O.all_rules(R.DEFAULT_RULES))]
NOISY_MATCHES = PLANT_CTES + [("m", O.all_rules(R.DEFAULT_RULES + R.NOISY_RULES))]
MARKED = NOISY_MATCHES + O.marked("m")

# ---------------------------------------------------------------- ingestion

_DOC_LINES = r"""doc_lines AS (SELECT source, doc_id::varchar AS file, generate_subscripts(l, 1)::int AS line, unnest(l) AS text
    FROM (SELECT doc_id, source, string_split_regex(regexp_replace(text, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS l
          FROM documents WHERE length(text) > 0))"""


@query(f"WITH {_DOC_LINES} SELECT source, file, line, md5(text) AS text_md5, length(text)::int AS n_chars FROM doc_lines")
def read_lines(spark, sf_dir):
    recs = src.document_records(base.documents(spark, sf_dir))
    return recs.select("source", "file", "line", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query(r"""WITH page_lines AS (SELECT page_id::varchar AS file, unnest(string_split_regex(
        regexp_replace(html, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r')) AS text FROM pages WHERE length(html) > 0)
    SELECT file, count(*) AS lines, sum(length(text))::bigint AS n_chars FROM page_lines GROUP BY file""")
def read_page_lines(spark, sf_dir):
    recs = src.page_records(base.table(spark, sf_dir, "pages"))
    return recs.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("n_chars"))


def _sessions(spark, sf_dir):
    text = F.concat(F.lit('{"history":['), "props", F.lit(',{"type":"'), "event_type", F.lit('"}],"id":"u'),
                    F.col("user_id").cast("string"), F.lit('","n":'), F.col("event_id").cast("string"), F.lit("}"))
    return base.table(spark, sf_dir, "events").select(
        F.lit("sessions").alias("source"), F.col("event_id").cast("string").alias("file"), text.alias("text"),
        F.lit(0).cast("bigint").alias("mtime_ms"), F.octet_length(text).cast("bigint").alias("size_bytes"))


@query("""SELECT event_id::varchar AS file, 1 AS line, '{"id":"u' || user_id || '","n":' || event_id || '}' AS text FROM events
    UNION ALL SELECT event_id::varchar, 2, replace(props, ': ', ':') FROM events
    UNION ALL SELECT event_id::varchar, 3, '{"type":"' || event_type || '"}' FROM events""")
def explode_json_documents(spark, sf_dir):
    return src.explode_json_documents(_sessions(spark, sf_dir)).select("file", "line", "text")


@query("""SELECT event_id::varchar AS file, 1 AS line, props AS text FROM events
    UNION ALL SELECT event_id::varchar, 2, '{"note":"a } in text","n":' || event_id || '}' FROM events WHERE event_id % 3 > 0
    UNION ALL SELECT event_id::varchar, 3, '{"last":{"deep":' || user_id || '}}' FROM events WHERE event_id % 3 = 1""")
def salvage_json_objects(spark, sf_dir):
    # A third is whole, a third is cut off inside its last object, a third inside a string of its second one.
    events = base.table(spark, sf_dir, "events")
    whole = F.concat(F.lit('text","n":'), F.col("event_id").cast("string"), F.lit('}, {"last":{"deep":'), F.col("user_id").cast("string"))
    rest = F.when(F.col("event_id") % 3 == 0, "te").when(F.col("event_id") % 3 == 1, F.concat(whole, F.lit("}}]"))).otherwise(whole)
    text = F.concat(F.lit("["), "props", F.lit(', {"note":"a } in '), rest)
    files = events.select(F.lit("s").alias("source"), F.col("event_id").cast("string").alias("file"), text.alias("text"),
                          F.lit(0).cast("bigint").alias("mtime_ms"), F.lit(0).cast("bigint").alias("size_bytes"))
    return src.salvage_json_objects(files).select("file", "line", "text")


@query("""SELECT event_id::varchar || '/' || user_id AS file, 1 AS line, event_type AS text FROM events
    UNION ALL SELECT event_id::varchar || '/' || user_id, 2, props FROM events""")
def table_to_records(spark, sf_dir):
    events = base.table(spark, sf_dir, "events").withColumn("props", F.col("props").cast("binary"))
    return src.table_to_records(events, "events", ["event_id", "user_id"]).select("file", "line", "text")


@query("""SELECT conv_id::varchar || '/' || turn AS file, 1 AS line, length('{"conv_id":' || conv_id || ',"turn":' || turn
    || ',"role":"' || role || '","n":' || length(text) || '}')::int AS n_chars FROM conversations""")
def table_rows_to_json_records(spark, sf_dir):
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    recs = src.table_to_records(rows, "conversations", ["conv_id", "turn"], as_json=True)
    return recs.select("file", "line", F.length("text").alias("n_chars"))


_PATHS = ("a/.claude/logs/x.jsonl", "p/-home-me/s.jsonl", "r/rollout-7.jsonl", "r/other.jsonl", ".specstory/h/one.md",
          "a/.claude/settings.local.json", "a/b/.mcp.json", ".cursor/rules/style.mdc", ".cursor/x/rules/no.mdc", "CLAUDE.md",
          ".env", ".env.local", "sub/.env", "node_modules/p/CLAUDE.md", ".git/x/AGENTS.md", ".vscode/tasks.json",
          "vscode/tasks.json", "src/main.py", "1/2/3/4/5/6/7/8/9/10/11/12/13/AGENTS.md", ".gemini/settings.json")
_LISTING = f"""listing AS (SELECT doc_id, ([{', '.join(O.quote(p) for p in _PATHS)}])[(doc_id % {len(_PATHS)} + 1)::int] AS path FROM documents),
    parts AS (SELECT *, string_split(path, '/') AS s FROM listing),
    seg AS (SELECT *, s[-1] AS name, CASE WHEN len(s) > 1 THEN s[-2] END AS parent, s[1:len(s) - 1] AS dirs FROM parts)"""


@query(f"""WITH {_LISTING} SELECT doc_id, path FROM seg WHERE NOT list_has_any(dirs, ['node_modules', '.git']) AND (
    (name LIKE '%.jsonl' AND (list_contains(dirs, '.claude') OR parent LIKE '-%' OR name LIKE 'rollout-%'))
    OR list_contains(dirs, '.specstory') OR (parent = '.claude' AND regexp_full_match(name, 'settings.*\\.json'))
    OR name IN ('.mcp.json', '.cursorrules', 'CLAUDE.md', 'CLAUDE.local.md', 'AGENTS.md')
    OR contains('/' || array_to_string(dirs, '/') || '/', '/.cursor/rules/')
    OR (parent = '.gemini' AND name = 'settings.json') OR (parent = '.vscode' AND name = 'tasks.json')
    OR (len(s) = 1 AND regexp_full_match(name, '\\.env(\\..+)?')))""")
def select_project_artifacts(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("doc_id") % len(_PATHS) + 1).cast("int"))
    listing = base.documents(spark, sf_dir).select("doc_id", path.alias("path"))
    return src.select_project_artifacts(listing)


def coverage_input(spark, sf_dir):
    docs = base.documents(spark, sf_dir)
    files = src.as_files(docs, "doc_id", "text", F.col("source"))
    listing = files.select("source", "file", "size_bytes", (F.col("file").cast("bigint") % 97 == 0).alias("broken"))
    lost = files.where(F.col("file").cast("bigint") % 89 == 1)
    recs = src.explode_lines(files).where((F.col("file").cast("bigint") % 97 != 0) & (F.col("size_bytes") <= 20000)
                                          & (F.col("file").cast("bigint") % 89 != 1))
    # The first line of some files cannot be read.
    recs = recs.withColumn("text", F.when((F.col("file").cast("bigint") % 79 != 3) | (F.col("line") > 1), F.col("text")))
    cut = files.where(F.col("file").cast("bigint") % 83 == 2)
    return src.coverage_report(listing, recs, lost.select("source", "file").union(cut.select("source", "file")), 20000)


_COVERAGE = f"""{_DOC_LINES}, f AS (SELECT source, doc_id::varchar AS file, doc_id, strlen(text) AS size FROM documents),
    seen AS (SELECT file, line, CASE WHEN file::bigint % 79 <> 3 OR line > 1 THEN text END AS text FROM doc_lines),
    r AS (SELECT file, count(*) AS lines, sum(strlen(text))::bigint AS bytes, count_if(text IS NULL) AS unmatched FROM seen GROUP BY file),
    j AS (SELECT f.source, f.file, doc_id % 97 = 0 AS broken, size > 20000 AS large, (doc_id % 89 = 1 OR doc_id % 83 = 2) AS err,
        CASE WHEN doc_id % 97 = 0 OR size > 20000 OR doc_id % 89 = 1 THEN 0 ELSE coalesce(lines, 0) END AS lines,
        CASE WHEN doc_id % 97 = 0 OR size > 20000 OR doc_id % 89 = 1 THEN 0 ELSE coalesce(bytes, 0) END AS bytes,
        CASE WHEN doc_id % 97 = 0 OR size > 20000 OR doc_id % 89 = 1 THEN 0 ELSE coalesce(unmatched, 0) END AS unmatched
        FROM f LEFT JOIN r USING (file)),
    coverage AS (SELECT source, file,
        CASE WHEN broken THEN 'failed' WHEN large THEN 'too-large' WHEN err AND lines > 0 THEN 'partial' WHEN err THEN 'failed'
             ELSE 'complete' END AS status,
        CASE WHEN broken THEN 'could not be resolved' WHEN large THEN 'too large to scan' WHEN err AND lines > 0 THEN 'only partially read'
             WHEN err THEN 'could not be read' WHEN unmatched > 0 THEN 'some lines could not be matched' END AS reason,
        lines::bigint AS lines, bytes::bigint AS bytes, unmatched::bigint AS unmatched FROM j)"""


@query(f"WITH {_COVERAGE} SELECT * FROM coverage")
def coverage_report(spark, sf_dir):
    return coverage_input(spark, sf_dir)


@query(f"WITH {_COVERAGE} SELECT DISTINCT source FROM coverage WHERE status IN ('complete', 'partial')")
def sources_scanned(spark, sf_dir):
    return src.sources_scanned(coverage_input(spark, sf_dir))


@query("SELECT doc_id::varchar AS file, strlen(text)::int AS n_chars, strlen(text)::bigint AS size_bytes FROM documents")
def binary_as_text(spark, sf_dir):
    files = src.as_files(base.documents(spark, sf_dir), "doc_id", "text", "bin").withColumn("content", F.col("text").cast("binary"))
    return src.binary_as_text(files).select("file", F.length("text").alias("n_chars"), "size_bytes")


@query(f"WITH {_DOC_LINES} SELECT file, (line + 1)::int AS line, text FROM doc_lines WHERE length(text) > 0")
def decode_base64_lines(spark, sf_dir):
    docs = src.as_files(base.documents(spark, sf_dir), "doc_id", "text", F.col("source"))
    # One base64 line must stay one line, so the line breaks of long encodings go.
    encoded = F.array_join(F.transform(src.lines_of(F.col("text")), lambda t: F.translate(F.base64(t.cast("binary")), "\r\n", "")), "\n")
    files = docs.withColumn("text", F.concat(F.lit("EVENTS v1\n"), encoded))
    return src.decode_base64_lines(src.explode_lines(files), "EVENTS v1").select("file", "line", "text")


# ---------------------------------------------------------------- planted corpus

@query(statement(PLANT_CTES, "SELECT file, line, md5(text) AS text_md5 FROM lines"))
def plant_corpus(spark, sf_dir):
    return base.planted_lines(spark, sf_dir).select("file", "line", F.md5("text").alias("text_md5"))


_TRUTH_ROWS = [("transcript-plain", "secret", "plain", "plain", "first", "plain", 0), ("agent-config-plain", "secret", "config", "config", "first", "config", 0),
               ("transcript-json-nested", "secret", "nested", "nested", "first", "nested", 0),
               ("transcript-echo", "secret", "plain", "plain", "re-exposed", "echo", 0), ("transcript-b64", "secret", "b64", "b64", "first", "b64", 0),
               ("transcript-split", "secret", "split", "split", "first", "split", 0),
               ("transcript-split", "secret", "split", "split", "part-continuation", "split", 1)]


def _truth_sql() -> list[tuple[str, str]]:
    n = r"len(string_split_regex(regexp_replace(text, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r'))"
    parts = [f"""SELECT doc_id::varchar AS file, doc_id::varchar || '-{off}{shift}' AS truth_id, '{cls}' AS class, '{kind}' AS kind,
            r_{v} AS rule_family, v_{v} AS value, ({n} + {plant.OFFSETS[off] + shift})::int AS line,
            doc_id::varchar || '/{g}' AS distinct_group, '{exp}' AS exposure FROM blocks"""
             for cls, kind, v, g, exp, off, shift in _TRUTH_ROWS]
    parts += [f"""SELECT doc_id::varchar, doc_id::varchar || '-{k}0', '{cls}', '{k}', '{fam}', l_{k}, ({n} + {plant.OFFSETS[k]})::int,
            doc_id::varchar || '/{k}', 'first' FROM blocks""" for cls, k, fam in (("suppress-placeholder", "suppress", "placeholder"),
                                                                               ("chaff-shaped", "chaff", "chaff"))]
    return [("truth", " UNION ALL ".join(parts))]


TRUTH = PLANT_CTES + _truth_sql()


@query(statement(TRUTH, "SELECT truth_id, class, kind, rule_family, md5(value) AS value_md5, line, distinct_group, exposure FROM truth"))
def planted_truth(spark, sf_dir):
    truth = plant.plant_corpus(base.documents(spark, sf_dir))[1]
    return truth.select("truth_id", "class", "kind", "rule_family", F.md5("value").alias("value_md5"), "line", "distinct_group", "exposure")


@query(statement(TRUTH, """SELECT truth_id FROM truth t LEFT JOIN lines l ON t.file = l.file AND t.line = l.line
    WHERE CASE WHEN class IN ('transcript-b64', 'transcript-split') THEN coalesce(contains(text, value), false) OR text IS NULL
          ELSE NOT coalesce(contains(text, value), false) END"""))
def verify_corpus(spark, sf_dir):
    planted, truth = plant.plant_corpus(base.documents(spark, sf_dir))
    return plant.verify_corpus(planted, truth).select("truth_id")


@query(statement(TRUTH, "SELECT truth_id FROM truth WHERE file::bigint % 7 = 0"))
def verify_broken_corpus(spark, sf_dir):
    # The plants of each seventh document were lost: all of its truth is contradicted.
    planted, truth = plant.plant_corpus(base.documents(spark, sf_dir))
    broken = planted.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("text")))
    return plant.verify_corpus(broken, truth).select("truth_id")


# ---------------------------------------------------------------- matching and suppression

_HIT = "source, file, line, rule_id, confidence, md5(value) AS value_md5"


def _hits(df):
    return df.select("source", "file", "line", "rule_id", "confidence", F.md5("value").alias("value_md5"))


@query(statement(MATCHES, f"SELECT {_HIT} FROM m"))
def scan_rules(spark, sf_dir):
    return _hits(extract.scan_rules(base.planted_lines(spark, sf_dir)))


@query(statement(NOISY_MATCHES, f"SELECT {_HIT} FROM m"))
def scan_rules_noisy(spark, sf_dir):
    return _hits(extract.scan_rules(base.planted_lines(spark, sf_dir), include_noisy=True))


_CONV_LINES = """lines AS (SELECT 'conversations' AS source, conv_id::varchar AS file, (turn + 1)::int AS line, 0 AS mtime_ms,
    text || ' ' || 'AKIA' || upper(translate(substr(md5(conv_id::varchar || '.' || turn), 1, 16), '0189', 'GHIJ')) AS text FROM conversations)"""


def key_of(seed):
    """A made-up access key per seed."""
    return F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(F.md5(seed), 1, 16), "0189", "GHIJ")))


def key_sql(seed: str) -> str:
    return f"'AKIA' || upper(translate(substr(md5({seed}), 1, 16), '0189', 'GHIJ'))"


def _key(conv="conv_id", turn="turn"):
    return key_of(F.concat(F.col(conv).cast("string"), F.lit("."), F.col(turn).cast("string")))


@query(f"WITH {_CONV_LINES}, m AS ({O.all_rules(R.DEFAULT_RULES)}) SELECT {_HIT} FROM m")
def scan_rules_conversations(spark, sf_dir):
    conv = base.table(spark, sf_dir, "conversations")
    return _hits(extract.scan_rules(src.conversation_records(conv.withColumn("text", F.concat("text", F.lit(" "), _key())))))


_PAGE_LINES = r"""lines AS (SELECT 'pages' AS source, page_id::varchar AS file, generate_subscripts(l, 1)::int AS line, unnest(l) AS text, 0 AS mtime_ms
    FROM (SELECT page_id, string_split_regex(regexp_replace(html, '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS l FROM pages WHERE length(html) > 0))"""


@query(f"WITH {_PAGE_LINES}, m AS ({O.all_rules(R.DEFAULT_RULES + R.NOISY_RULES)}) SELECT {_HIT} FROM m")
def scan_rules_pages(spark, sf_dir):
    return _hits(extract.scan_rules(src.page_records(base.table(spark, sf_dir, "pages")), include_noisy=True))


def _kept(where: str) -> str:
    return statement(MARKED, f"SELECT source, file, line, rule_id, md5(value) AS value_md5 FROM ctx WHERE {where}")


def _kept_cols(df):
    return df.select("source", "file", "line", "rule_id", F.md5("value").alias("value_md5"))


def _noisy(spark, sf_dir):
    return extract.scan_rules(base.planted_lines(spark, sf_dir), include_noisy=True)


@query(_kept(f"value NOT IN ({', '.join(O.quote(v) for v in R.VENDOR_EXAMPLES)})"))
def suppress_vendor_examples(spark, sf_dir):
    return _kept_cols(suppress.suppress_vendor_examples(_noisy(spark, sf_dir)))


@query(_kept("NOT (length(value) >= 12 AND right(value, 12) = repeat(right(value, 1), 12))"))
def suppress_zero_entropy_tail(spark, sf_dir):
    return _kept_cols(suppress.suppress_zero_entropy_tail(_noisy(spark, sf_dir)))


@query(_kept(f"NOT regexp_matches(before, {O.quote(O.re2(R.PLACEHOLDER_CONTEXT, True))})"))
def suppress_placeholder_context(spark, sf_dir):
    return _kept_cols(suppress.suppress_placeholder_context(_noisy(spark, sf_dir)))


@query(_kept(f"rule_id NOT IN ({O.NOISY}) OR {O.bigram_fraction('value')} < 0.2"))
def suppress_natural_language(spark, sf_dir):
    return _kept_cols(suppress.suppress_natural_language(_noisy(spark, sf_dir)))


@query(statement(MARKED, "SELECT source, file, line, rule_id, confidence, suppressed_reason, md5(value) AS value_md5 FROM marked"))
def mark_suppressed(spark, sf_dir):
    df = base.raw_matches(spark, sf_dir)
    return df.select("source", "file", "line", "rule_id", "confidence", "suppressed_reason", F.md5("value").alias("value_md5"))


@query(statement(MARKED, "SELECT rule_id, confidence, count(*) AS n FROM marked WHERE suppressed_reason IS NULL GROUP BY ALL"))
def apply_suppression(spark, sf_dir):
    hits = _noisy(spark, sf_dir).withColumn("category", F.lit("secret"))
    return suppress.apply_suppression(hits).groupBy("rule_id", "confidence").agg(F.count("*").alias("n"))


@query(statement(MARKED, "SELECT suppressed_reason, count(*) AS n FROM marked WHERE suppressed_reason IS NOT NULL GROUP BY ALL"))
def suppressed_counts(spark, sf_dir):
    return suppress.suppressed_counts(_noisy(spark, sf_dir).withColumn("category", F.lit("secret")))


@query(statement(MARKED, "SELECT rule_id, confidence, suppressed_reason IS NULL AS live, count(*) AS n FROM marked GROUP BY ALL"))
def resolve_confidence(spark, sf_dir):
    return (base.raw_matches(spark, sf_dir).groupBy("rule_id", "confidence", F.col("suppressed_reason").isNull().alias("live"))
            .agg(F.count("*").alias("n")))


@query(statement(MARKED, f"""SELECT file, line, rule_id, round({O.bigram_fraction('value')}, 6) AS bigram_fraction,
    {O.bigram_fraction('value')} < 0.2 AS is_random FROM ctx"""))
def score_randomness(spark, sf_dir):
    return suppress.score_randomness(_noisy(spark, sf_dir)).select(
        "file", "line", "rule_id", F.round("bigram_fraction", 6).alias("bigram_fraction"), "is_random")


@query(f"""WITH {_DOC_LINES}, w AS (SELECT file, line, unnest(string_split(text, ' ')) AS word FROM doc_lines)
    SELECT file, count(*) AS words, count_if({O.bigram_fraction('word')} < 0.2) AS random_words FROM w GROUP BY file""")
def randomness_of_words(spark, sf_dir):
    from lodesieve.functions.text import is_random
    words = src.document_records(base.documents(spark, sf_dir)).select("file", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("file").agg(F.count("*").alias("words"), F.count_if(is_random(F.col("word"))).alias("random_words"))


@query(statement(MATCHES, "SELECT file, line, rule_id, confidence, md5(value) AS value_md5 FROM m"))
def extract_matches_in_sql(spark, sf_dir):
    extract.extract_matches_sql(spark)
    base.planted_lines(spark, sf_dir).createOrReplaceTempView("planted_lines")
    return spark.sql("SELECT file, line, m.rule_id, m.confidence, md5(m.value) AS value_md5 FROM "
                     "(SELECT file, line, extract_matches(text) AS found FROM planted_lines), LATERAL explode(found) AS e(m)")


# ---------------------------------------------------------------- decoding and seams

_DECODED = PLANT_CTES + [
    ("runs", """SELECT source, file, line, mtime_ms, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_-]{24,}=*')) AS run FROM lines"""),
    # Standard alphabet and whole groups, so that the strict decoder of the engine accepts the run.
    ("plain", """SELECT *, rtrim(translate(run, '-_', '+/'), '=') AS b FROM runs"""),
    ("bytes", """SELECT *, try(from_base64(b || repeat('=', ((4 - length(b) % 4) % 4)::int))) AS raw FROM plain WHERE length(b) % 4 <> 1"""),
    ("texts", r"""SELECT source, file, line, mtime_ms, run, CASE WHEN regexp_full_match(hex(raw),
            '(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])+') THEN decode(raw) END AS text
        FROM bytes WHERE raw IS NOT NULL AND rtrim(base64(raw), '=') = b"""),
    ("readable", "SELECT * FROM texts WHERE text IS NOT NULL"),
    ("m", O.all_rules(R.HIGH_RULES, "readable", "source, file, line, mtime_ms, run")),
]


@query(statement(_DECODED, """SELECT DISTINCT source, file, line, rule_id, md5(value) AS value_md5,
    CASE WHEN regexp_matches(run, '[-_]') THEN 'base64url' ELSE 'base64' END AS encoding FROM m"""))
def scan_decoded(spark, sf_dir):
    return decode.scan_decoded(base.planted_lines(spark, sf_dir)).select(
        "source", "file", "line", "rule_id", F.md5("value").alias("value_md5"), "encoding")


_CONTENT = r"""CASE WHEN regexp_matches(text, '^\s*[\[{]') THEN list_reduce(list_prepend('', regexp_extract_all(text,
    '"((?:[^"\\]|\\.)*)"', 1)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) ELSE '' END"""
_WITH_CONTENT = ("contents", f"SELECT source, file, line, mtime_ms, CASE WHEN length(c) >= 24 THEN c ELSE text END AS content "
                 f"FROM (SELECT *, {_CONTENT} AS c FROM lines) WHERE length(text) > 0")


@query(statement(PLANT_CTES, f"SELECT file, line, md5(CASE WHEN length(c) >= 24 THEN c ELSE text END) AS content_md5 FROM (SELECT *, {_CONTENT} AS c FROM lines)"))
def with_content(spark, sf_dir):
    recs = base.planted_lines(spark, sf_dir)
    return boundary.with_content(recs).select("file", "line", F.md5("content").alias("content_md5"))


def seam_ctes(rules):
    # A rule that already matches completely on one side, flush with the seam, did not need the other side.
    flush = " UNION ALL ".join(
        f"""SELECT * FROM crossing WHERE rule_id = {O.quote(r.id)}
            AND NOT coalesce(ends_with(tail, {O.rule_values(r, 'tail')}[-1]) AND length({O.rule_values(r, 'tail')}[-1]) = seam - s, false)
            AND NOT coalesce(starts_with(head, {O.rule_values(r, 'head')}[1]) AND length({O.rule_values(r, 'head')}[1]) = e - seam, false)"""
        for r in rules)
    return [
        _WITH_CONTENT,
        # Whole lines on both sides: the windows of the operator must lose nothing.
        ("seams", """SELECT a.source, a.file, a.line, a.mtime_ms, a.content AS tail, b.content AS head, a.content || b.content AS text
            FROM contents a JOIN contents b ON a.source = b.source AND a.file = b.file AND a.line + 1 = b.line"""),
        ("m", O.all_rules(rules, "seams", "source, file, line, mtime_ms, tail, head")),
        ("located", "SELECT *, strpos(text, value) - 1 AS s, strpos(text, value) - 1 + length(value) AS e, length(tail) AS seam FROM m"),
        ("crossing", "SELECT * FROM located WHERE seam - s >= 4 AND e - seam >= 4"),
        ("split", flush),
    ]


_SEAM_CTES = seam_ctes(R.DEFAULT_RULES)


def _long_fields():
    """Two lines per document with a token field of 900 or 3,900 characters, cut anywhere behind its opening quote."""
    size = F.when(F.col("doc_id") % 2 == 0, 900).otherwise(3900)
    name = F.when(F.col("doc_id") % 3 == 0, "refresh_token").otherwise("access_token")
    value = F.left(F.repeat(F.md5(F.col("doc_id").cast("string")), 122), size)
    cut = (4 + F.conv(F.substring(F.md5(F.concat(F.lit("cut"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("int") % (size - 8)).cast("int")
    line = F.regexp_replace("text", r"[\r\n]+", " ")
    return [F.concat(line, F.lit(' "'), name, F.lit('":   "'), F.left(value, cut)), F.concat(F.substr(value, cut + 1), F.lit('" '), line)]


_LONG_FIELDS = r"""sized AS (SELECT doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS t, CASE WHEN doc_id % 2 = 0 THEN 900 ELSE 3900 END AS size,
        CASE WHEN doc_id % 3 = 0 THEN 'refresh_token' ELSE 'access_token' END AS name FROM documents),
    cut AS (SELECT *, left(repeat(md5(doc_id::varchar), 122), size) AS value, 4 + ('0x' || left(md5('cut' || doc_id), 6))::int % (size - 8) AS cut FROM sized),
    lines AS (SELECT 'documents' AS source, doc_id::varchar AS file, 1 AS line, 0 AS mtime_ms, t || ' "' || name || '":   "' || left(value, cut) AS text FROM cut
        UNION ALL SELECT 'documents', doc_id::varchar, 2, 0, substr(value, cut + 1) || '" ' || t FROM cut)"""


@query(f"WITH {_LONG_FIELDS}, " + ", ".join(f"{n} AS ({b})" for n, b in _SEAM_CTES) + " SELECT file, line, rule_id, md5(value) AS value_md5 FROM split")
def scan_boundary_long_fields(spark, sf_dir):
    rows = base.documents(spark, sf_dir).select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("file"), F.posexplode(F.array(*_long_fields())).alias("i", "text"))
    recs = rows.select("source", "file", (F.col("i") + 1).alias("line"), "text", F.lit(0).cast("bigint").alias("mtime_ms"), F.octet_length("text").alias("size_bytes"))
    return boundary.scan_boundary(recs).select("file", "line", "rule_id", F.md5("value").alias("value_md5"))


@query(statement(PLANT_CTES + _SEAM_CTES, "SELECT source, file, line, rule_id, md5(value) AS value_md5 FROM split"))
def scan_boundary(spark, sf_dir):
    return boundary.scan_boundary(base.planted_lines(spark, sf_dir)).select(
        "source", "file", "line", "rule_id", F.md5("value").alias("value_md5"))


# Conversations in which every even turn ends, and the next one begins, with half of a key.
_CONV_SPLIT = """keyed AS (SELECT *, 'AKIA' || upper(translate(substr(md5(conv_id::varchar || '.' || (turn - turn % 2)), 1, 16), '0189', 'GHIJ')) AS k
        FROM conversations),
    lines AS (SELECT 'conversations' AS source, conv_id::varchar AS file, (turn + 1)::int AS line, 0 AS mtime_ms,
        CASE WHEN turn % 2 = 0 THEN text || ' ' || left(k, 10) ELSE substr(k, 11) || ' ' || text END AS text FROM keyed)"""


def split_conversations(conversations):
    conv = conversations.withColumn("even", F.col("turn") - F.col("turn") % 2)
    k = _key(turn="even")
    text = (F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" "), F.substring(k, 1, 10)))
            .otherwise(F.concat(F.substring(k, 11, 10), F.lit(" "), F.col("text"))))
    return conv.withColumn("text", text)


SPLIT_IN_CONVERSATIONS = f"WITH {_CONV_SPLIT}, " + ", ".join(f"{n} AS ({b})" for n, b in _SEAM_CTES)


@query(SPLIT_IN_CONVERSATIONS + """
    SELECT file, unnest([line, line + 1])::int AS line, rule_id, line::varchar || '-' || (line + 1) AS span, md5(value) AS value_md5 FROM split""")
def scan_boundary_conversations(spark, sf_dir):
    recs = src.conversation_records(split_conversations(base.table(spark, sf_dir, "conversations")))
    found = boundary.both_lines(boundary.scan_boundary(recs))
    return found.select("file", "line", "rule_id", F.array_join(F.col("span_lines").cast("array<string>"), "-").alias("span"),
                        F.md5("value").alias("value_md5"))


# ---------------------------------------------------------------- pairs, expiry, personal data, injection

def _pair_sql(anchors: tuple[str, ...], candidate: str, paired_id: str) -> str:
    return statement(MARKED + [
        ("cand", f"""SELECT *, list_distinct(list_filter(regexp_extract_all(text, {O.quote(candidate)}), lambda v: v <> value
            AND left(v, 12) <> repeat(left(v, 1), 12) AND right(v, 12) <> repeat(right(v, 1), 12))) AS c
            FROM marked WHERE rule_id IN ({', '.join(O.quote(a) for a in anchors)})"""),
    ], f"""SELECT file, line, rule_id, md5(value) AS value_md5, CASE WHEN suppressed_reason IS NULL AND len(c) = 1 THEN {O.redact('c[1]')} END AS paired_preview,
        CASE WHEN suppressed_reason IS NULL AND len(c) = 1 THEN {O.quote(paired_id)} END AS paired_rule_id FROM cand""")


def _pair(df):
    return df.select("file", "line", "rule_id", F.md5("value").alias("value_md5"), redact(F.col("paired_value")).alias("paired_preview"), "paired_rule_id")


@query(_pair_sql(pairing.PAIRINGS[0].anchors, pairing.PAIRINGS[0].candidate, "aws_secret_access_key_paired"))
def pair_aws(spark, sf_dir):
    return _pair(pairing.pair_aws(base.raw_matches(spark, sf_dir)))


@query(_pair_sql(pairing.PAIRINGS[1].anchors, pairing.PAIRINGS[1].candidate, "planetscale_id"))
def pair_planetscale(spark, sf_dir):
    return _pair(pairing.pair_planetscale(base.raw_matches(spark, sf_dir)))


@query(_pair_sql(pairing.PAIRINGS[2].anchors, pairing.PAIRINGS[2].candidate, "mongodb_atlas_client_id"))
def pair_mongodb_atlas(spark, sf_dir):
    return _pair(pairing.pair_mongodb_atlas(base.raw_matches(spark, sf_dir)))


_PAIR_CASES = ((0, 40, "aws"), (1, 12, "planetscale"), (2, 34, "mongodb"))


def _pair_window_cases() -> str:
    """A mate stands whole inside the window if its far end is no further away than the window is wide."""
    return " UNION ALL ".join(f"""SELECT doc_id::varchar AS file, {2 * i + side + 1} AS line, '{name}' AS kind,
        doc_id % 7 - 3 + {pairing.PAIRINGS[i].window - n} + {n} <= {pairing.PAIRINGS[i].window} AS paired FROM documents"""
                              for i, n, name in _PAIR_CASES for side in (0, 1))


@query(_pair_window_cases())
def pair_windows(spark, sf_dir):
    """Mates from three characters inside to three outside of the window, before and behind the anchor."""
    d = F.col("doc_id").cast("string")
    h = F.concat(F.md5(d), F.md5(F.concat(F.lit("x"), d)))
    anchors = (key_of(d), F.concat(F.lit("pscale_tkn_"), F.left(h, F.lit(43))), F.concat(F.lit("mdb_sa_sk_"), F.left(h, F.lit(40))))
    mates = (F.right(h, F.lit(40)), F.right(h, F.lit(12)), F.concat(F.lit("mdb_sa_id_"), F.right(h, F.lit(24))))
    lines = []
    for i, n, name in _PAIR_CASES:
        gap = F.repeat(F.lit(" "), (F.col("doc_id") % 7 - 3 + pairing.PAIRINGS[i].window - n).cast("int"))
        lines += [F.concat(anchors[i], gap, mates[i]), F.concat(mates[i], gap, anchors[i])]
    docs = base.documents(spark, sf_dir).select(d.alias("file"), F.posexplode(F.array(*lines)).alias("i", "text"))
    recs = docs.select(F.lit("s").alias("source"), "file", (F.col("i") + 1).alias("line"), "text", F.lit(0).cast("bigint").alias("mtime_ms"),
                       F.octet_length("text").cast("bigint").alias("size_bytes"))
    found = pairing.with_pairs(suppress.mark_suppressed(extract.scan_rules(recs, windows=pairing.PAIR_WINDOWS).withColumn("category", F.lit("secret"))))
    kind = F.coalesce(*[F.when(F.col("rule_id").isin(*pairing.PAIRINGS[i].anchors), F.lit(name)) for i, _, name in _PAIR_CASES])
    return found.select("file", "line", kind.alias("kind"), F.col("paired_value").isNotNull().alias("paired"))


_JWT_BODY = "rtrim(translate(string_split(value, '.')[2], '-_', '+/'), '=')"
JWT_MS = (f"CASE WHEN rule_id = 'jwt' AND try(from_base64({_JWT_BODY} || repeat('=', ((4 - length({_JWT_BODY}) % 4) % 4)::int))) IS NOT NULL THEN "
          f"try((regexp_extract(try(decode(from_base64({_JWT_BODY} || repeat('=', ((4 - length({_JWT_BODY}) % 4) % 4)::int)))), "
          "'^\\{.*\"exp\":([0-9]+)\\}$', 1))::bigint * 1000) END")


@query(statement(MARKED, f"SELECT file, line, {JWT_MS} AS jwt_expires_at_ms FROM marked WHERE rule_id = 'jwt' AND suppressed_reason IS NULL"))
def with_jwt_expiry(spark, sf_dir):
    jwt = tuple(r for r in R.DEFAULT_RULES if r.id == "jwt")
    found = plan.findings_of(plan.expanded_matches(plan.classify(
        extract.scan_rules(base.planted_lines(spark, sf_dir), jwt), plan.ScanOptions()), False))
    return found.select("file", "line", "jwt_expires_at_ms")


LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::int
    WHEN substr(reverse(d), i, 1)::int * 2 > 9 THEN substr(reverse(d), i, 1)::int * 2 - 9 ELSE substr(reverse(d), i, 1)::int * 2 END)) % 10 = 0"""
MOD97 = """list_reduce(list_prepend(0::bigint, list_transform(range(1, length(v) + 1), lambda i: (CASE WHEN substr(v, i, 1) BETWEEN 'A' AND 'Z'
    THEN ord(substr(v, i, 1)) - 55 ELSE ord(substr(v, i, 1)) - 48 END)::bigint)), lambda a, x: CASE WHEN x >= 10 THEN (a * 100 + x) % 97
    ELSE (a * 10 + x) % 97 END) = 1"""
_PII_CHECKED = f"""checked AS (SELECT * FROM (SELECT *, regexp_replace(value, '[ -]', '', 'g') AS d, substr(value, 5) || left(value, 4) AS v FROM m)
    WHERE CASE rule_id WHEN 'credit_card_number' THEN length(d) BETWEEN 13 AND 19 AND {LUHN} WHEN 'iban' THEN length(value) BETWEEN 15 AND 34 AND {MOD97} ELSE true END)"""
_PII = {r.id: r for r in R.PII_RULES}


def _pii_sql(rule_ids: list[str], lines: str) -> str:
    body = O.all_rules(tuple(_PII[i] for i in rule_ids), "lines", "source, file, line, mtime_ms")
    return f"WITH {lines}, m AS ({body}), {_PII_CHECKED} SELECT {_HIT} FROM checked"


_PLANT_LINES = ", ".join(f"{n} AS ({b})" for n, b in PLANT_CTES)


@query(_pii_sql(["us_ssn"], _PLANT_LINES))
def scan_pii_us_ssn(spark, sf_dir):
    return _hits(pii.scan_pii(base.planted_lines(spark, sf_dir), ["us_ssn"]))


@query(_pii_sql(["credit_card_number"], _PLANT_LINES))
def scan_pii_credit_card_number(spark, sf_dir):
    return _hits(pii.scan_pii(base.planted_lines(spark, sf_dir), ["credit_card_number"]))


@query(_pii_sql(["iban"], _PLANT_LINES))
def scan_pii_iban(spark, sf_dir):
    return _hits(pii.scan_pii(base.planted_lines(spark, sf_dir), ["iban"]))


@query(_pii_sql(["us_ssn", "credit_card_number", "iban"], _PAGE_LINES))
def scan_pii_pages(spark, sf_dir):
    return _hits(pii.scan_pii(src.page_records(base.table(spark, sf_dir, "pages"))))


# The checksum holds for every planted phrase except in each fifth document.
@query(statement(PLANT_CTES, f"""SELECT l.file, l.line, md5(v_seed) AS value_md5 FROM lines l JOIN valued v ON l.file = v.doc_id::varchar
    WHERE l.text = 'backup: ' || v_seed || '.' AND v.doc_id % 5 <> 0"""))
def scan_pii_crypto_seed_phrase(spark, sf_dir):
    found = pii.scan_pii(base.planted_lines(spark, sf_dir), ["crypto_seed_phrase"], plant.synthetic_wordlist())
    return found.select("file", "line", F.md5("value").alias("value_md5"))


def _pii_flow_sql() -> str:
    body = O.all_rules(R.PII_RULES, "lines", "source, file, line, mtime_ms")
    tail = ", ".join(f"{n} AS ({b})" for n, b in O.marked("checked"))
    return (f"WITH {_PLANT_LINES}, m AS ({body}), {_PII_CHECKED}, {tail} "
            "SELECT file, line, rule_id, confidence, suppressed_reason, md5(value) AS value_md5 FROM marked")


@query(_pii_flow_sql())
def pii_findings(spark, sf_dir):
    found = suppress.mark_suppressed(pii.scan_pii(base.planted_lines(spark, sf_dir)).withColumn("category", F.lit("pii")))
    return found.select("file", "line", "rule_id", "confidence", "suppressed_reason", F.md5("value").alias("value_md5"))


@query(statement(PLANT_CTES + [("m", O.all_rules((R.CHATML_RULE,)))], "SELECT file, line, value FROM m"))
def scan_injection_chatml(spark, sf_dir):
    return injection.scan_injection(base.planted_lines(spark, sf_dir)).where("rule_id = 'chatml_special_token'").select("file", "line", "value")


_HIDDEN = [
    ("chars", "SELECT file, line, text, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS c FROM lines "
              r"WHERE regexp_matches(text, '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{E0000}-\x{E007F}]')"),
    ("bad", """SELECT *, ord(c) AS cp FROM chars WHERE ord(c) IN (8203, 8288) OR ord(c) BETWEEN 917504 AND 917631 OR (ord(c) = 65279 AND i > 1)
        OR (ord(c) IN (8204, 8205) AND coalesce(ord(nullif(substr(text, (i - 1)::int, 1), '')), 0) <= 127
            AND coalesce(ord(nullif(substr(text, (i + 1)::int, 1), '')), 0) <= 127)"""),
    ("counted", "SELECT file, line, cp, min(i) AS first, count(*) AS n FROM bad GROUP BY ALL"),
]
_HIDDEN_SUMMARY = "string_agg('U+' || printf('%04X', cp) || ' ×' || n, ', ' ORDER BY first)"


@query(statement(PLANT_CTES + _HIDDEN, f"SELECT file, line, {_HIDDEN_SUMMARY} AS summary FROM counted GROUP BY file, line"))
def scan_injection_zero_width(spark, sf_dir):
    found = injection.scan_injection(base.planted_lines(spark, sf_dir)).where("rule_id = 'zero_width_hidden_instruction'")
    return found.select("file", "line", F.col("value").alias("summary"))


@query(statement(PLANT_CTES + [("m", O.all_rules((R.OVERRIDE_PHRASE_RULE,)))], "SELECT file, line, confidence, value FROM m"))
def scan_injection_override_phrase(spark, sf_dir):
    found = injection.scan_injection(base.planted_lines(spark, sf_dir), include_noisy=True).where("rule_id = 'injection_override_phrase'")
    return found.select("file", "line", "confidence", "value")


@query("""SELECT doc_id::varchar AS file, 0 AS block, 'image/png' AS media_type, octet_length(encode('png ' || doc_id))::int AS n_bytes FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT doc_id::varchar, 1, 'image/jpeg', octet_length(encode('jpeg ' || doc_id))::int FROM documents WHERE doc_id % 3 = 0""")
def extract_image_blocks(spark, sf_dir):
    # Blocks at two depths, and one with a media type that is not an image.
    key = F.col("doc_id").cast("string")

    def block(media: str, prefix: str):
        data = F.base64(F.concat(F.lit(prefix), key).cast("binary"))
        return F.concat(F.lit('{"type":"image","source":{"type":"base64","media_type":"' + media + '","data":"'), data, F.lit('"}}'))

    text = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"content":['), block("image/png", "png "), F.lit(',{"deep":[{"x":'),
                                                     block("image/jpeg", "jpeg "), F.lit("}]}]}")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), block("image/png", "png "), F.lit("]")))
            .otherwise(F.concat(F.lit("["), block("image/tiff", "tiff "), F.lit("]"))))
    recs = src.explode_lines(src.as_files(base.documents(spark, sf_dir).withColumn("text", text), "doc_id", "text", F.col("source")))
    return images.extract_image_blocks(recs).select("file", "block", "media_type", "n_bytes")


# ---------------------------------------------------------------- masking

@query(statement(NOISY_MATCHES, f"SELECT file, line, rule_id, {O.redact('value')} AS preview FROM m"))
def with_preview(spark, sf_dir):
    return masking.with_preview(_noisy(spark, sf_dir)).select("file", "line", "rule_id", "preview")


def _redact_sql(text: str) -> str:
    """Planted lines hold one secret each, so masking is one replacement per line and rule."""
    live = statement(MATCHES + [
        ("live", f"SELECT DISTINCT file, line, value FROM m WHERE confidence = 'high' AND value NOT IN ({', '.join(O.quote(v) for v in R.VENDOR_EXAMPLES)}) "
                 "AND NOT (length(value) >= 12 AND right(value, 12) = repeat(right(value, 1), 12))"),
        ("one", f"SELECT file, line, list(value ORDER BY length(value) DESC, value) AS vs, list({O.redact('value')} ORDER BY length(value) DESC, value) AS ms FROM live GROUP BY file, line"),
        ("masked", "SELECT l.file, l.line, CASE WHEN vs IS NULL THEN text WHEN len(vs) = 1 THEN replace(text, vs[1], ms[1]) "
                   "ELSE replace(replace(text, vs[1], ms[1]), vs[2], ms[2]) END AS text FROM lines l LEFT JOIN one o ON l.file = o.file AND l.line = o.line"),
    ], text)
    return live


@query(_redact_sql("SELECT file, line, md5(text) AS text_md5 FROM masked"))
def redact_text(spark, sf_dir):
    recs = base.planted_lines(spark, sf_dir)
    return masking.redact_text(recs, ["text"]).select("file", "line", F.md5("text").alias("text_md5"))


@query(statement(MARKED, f"""SELECT source, file, line, rule_id, {O.fingerprint('rule_id', O.redact('value'), 'file')} AS fingerprint FROM marked"""))
def finding_fingerprint(spark, sf_dir):
    df = masking.with_preview(base.raw_matches(spark, sf_dir))
    return df.select("source", "file", "line", "rule_id", fingerprint(F.col("rule_id"), F.col("preview"), F.col("file")).alias("fingerprint"))


# ---------------------------------------------------------------- the whole scan

FINDINGS = MARKED + [
    ("live", f"SELECT *, {O.redact('value')} AS preview FROM marked WHERE suppressed_reason IS NULL"),
    ("cand", f"""SELECT *, list_distinct(list_filter(CASE WHEN rule_id IN ('aws_access_key_id', 'aws_session_token') THEN regexp_extract_all(text, {O.quote(pairing.PAIRINGS[0].candidate)})
            WHEN rule_id = 'planetscale_secret' THEN regexp_extract_all(text, {O.quote(pairing.PAIRINGS[1].candidate)})
            WHEN rule_id = 'mongodb_atlas_secret' THEN regexp_extract_all(text, {O.quote(pairing.PAIRINGS[2].candidate)}) ELSE [] END,
            lambda v: v <> value AND left(v, 12) <> repeat(left(v, 1), 12) AND right(v, 12) <> repeat(right(v, 1), 12))) AS c FROM live"""),
    ("mated", f"SELECT *, CASE WHEN len(c) = 1 THEN c[1] END AS mate, CASE WHEN len(c) = 1 THEN {O.redact('c[1]')} END AS mate_preview FROM cand"),
    ("bare", f"""SELECT rule_id, label, confidence, 'raw' AS pass, source, file, line, preview, mtime_ms,
            CASE WHEN rule_id LIKE 'aws%' THEN mate_preview END AS paired_secret_preview, NULL AS paired_access_key_preview,
            CASE WHEN rule_id NOT LIKE 'aws%' THEN mate_preview END AS paired_other_preview,
            CASE WHEN rule_id NOT LIKE 'aws%' AND mate IS NOT NULL THEN 'id' END AS paired_other_label, {JWT_MS} AS jwt_expires_at_ms, value FROM mated
        UNION ALL SELECT CASE WHEN rule_id LIKE 'aws%' THEN 'aws_secret_access_key_paired' WHEN rule_id LIKE 'planet%' THEN 'planetscale_id' ELSE 'mongodb_atlas_client_id' END,
            CASE WHEN rule_id LIKE 'aws%' THEN {O.quote(R.PAIRED_LABELS['aws_secret_access_key_paired'])} WHEN rule_id LIKE 'planet%'
                THEN {O.quote(R.PAIRED_LABELS['planetscale_id'])} ELSE {O.quote(R.PAIRED_LABELS['mongodb_atlas_client_id'])} END,
            'high', 'paired', source, file, line, mate_preview, mtime_ms, NULL, CASE WHEN rule_id LIKE 'aws%' THEN preview END,
            CASE WHEN rule_id NOT LIKE 'aws%' THEN preview END, CASE WHEN rule_id NOT LIKE 'aws%' THEN 'secret' END, NULL, mate FROM mated WHERE mate IS NOT NULL"""),
    ("findings", f"SELECT *, {O.fingerprint('rule_id', 'preview', 'file')} AS fingerprint FROM bare"),
]
_FINDING_COLS = ("rule_id", "label", "confidence", "pass", "source", "file", "line", "preview", "mtime_ms", "paired_secret_preview",
                 "paired_access_key_preview", "paired_other_preview", "paired_other_label", "jwt_expires_at_ms", "fingerprint")


@query(statement(FINDINGS, f"SELECT {', '.join(_FINDING_COLS)} FROM findings"))
def raw_findings(spark, sf_dir):
    return base.raw_findings(spark, sf_dir).select(*_FINDING_COLS)


def full_scan_ctes() -> list[tuple[str, str]]:
    """Default scan: raw and paired, decoded, and split values on both of their lines."""
    dec = [(n if n in ("runs", "bytes", "texts", "readable") else f"dec_{n}", b) for n, b in _DECODED[len(PLANT_CTES):]]
    dec = [(n, b.replace("FROM plain", "FROM dec_plain")) for n, b in dec]
    seam = [(f"seam_{n}" if n == "m" else n, b.replace("FROM m", "FROM seam_m")) for n, b in _SEAM_CTES]
    # Default rules only: the broad ones are opt-in.
    base_ctes = [(n, b) for n, b in FINDINGS]
    base_ctes[len(PLANT_CTES)] = ("m", O.all_rules(R.DEFAULT_RULES))
    return base_ctes + dec + seam + [
        ("extra", f"""SELECT *, {O.REASON} AS suppressed_reason FROM (
            SELECT DISTINCT source, file, line, rule_id, label, 'high' AS confidence, value, 'decoded' AS pass, NULL AS before,
                CASE WHEN regexp_matches(run, '[-_]') THEN 'base64url' ELSE 'base64' END AS encoding FROM dec_m
            UNION ALL SELECT source, file, unnest([line, line + 1])::int, rule_id, label, confidence, value, 'boundary', NULL, NULL FROM split)"""),
        ("everything", f"""SELECT rule_id, confidence, pass, source, file, line, preview, NULL AS encoding, value FROM findings
            UNION ALL SELECT rule_id, confidence, pass, source, file, line, {O.redact('value')}, encoding, value FROM extra WHERE suppressed_reason IS NULL"""),
    ]


def full_scan_sql() -> str:
    return statement(full_scan_ctes(), f"SELECT * EXCLUDE (value), {O.fingerprint('rule_id', 'preview', 'file')} AS fingerprint FROM everything")


_SCAN_COLS = ("rule_id", "confidence", "pass", "source", "file", "line", "preview", "encoding", "fingerprint")


def all_findings_ctes() -> list[tuple[str, str]]:
    """All passes with all options: ``findings`` also holds decoded and split values, personal data and injection markers."""
    whole = full_scan_ctes()
    whole = [(n, b) for n, b in whole if n not in ("extra", "everything")]
    at = next(i for i, (n, _) in enumerate(whole) if n == "m")
    whole[at] = FINDINGS[at]  # with the broad rules
    whole = [("raw_part" if n == "findings" else n, b) for n, b in whole]
    secrets = seam_ctes(R.DEFAULT_RULES + R.NOISY_RULES)
    first = next(i for i, (n, _) in enumerate(whole) if n == "contents")
    whole = whole[:first] + [(f"seam_{n}" if n == "m" else n, b.replace("FROM m", "FROM seam_m")) for n, b in secrets]
    inner = ", ".join(f"{n} AS ({b})" for n, b in O.marked("checked"))
    personal = f"WITH m AS ({O.all_rules(R.PII_RULES)}), {_PII_CHECKED}, {inner} SELECT * FROM marked WHERE suppressed_reason IS NULL"
    hidden = ", ".join(f"{n} AS ({b.replace('SELECT file, line', 'SELECT source, mtime_ms, file, line')})" for n, b in _HIDDEN)
    z = R.ZERO_WIDTH_RULE
    marks = f"""WITH m AS ({O.all_rules((R.CHATML_RULE, R.OVERRIDE_PHRASE_RULE))}), {hidden}
        SELECT source, file, line, mtime_ms, rule_id, label, confidence, value FROM m
        UNION ALL SELECT source, file, line, mtime_ms, {O.quote(z.id)}, {O.quote(z.label)}, {O.quote(z.confidence)}, {_HIDDEN_SUMMARY}
        FROM counted GROUP BY source, file, line, mtime_ms"""
    return whole + [
        ("personal", personal), ("marks", marks),
        ("extra", f"""SELECT *, {O.REASON} AS suppressed_reason FROM (
            SELECT DISTINCT source, file, line, mtime_ms, rule_id, label, 'high' AS confidence, value, 'decoded' AS pass, NULL AS before,
                CASE WHEN regexp_matches(run, '[-_]') THEN 'base64url' ELSE 'base64' END AS encoding FROM dec_m
            UNION ALL SELECT source, file, unnest([line, line + 1])::int, mtime_ms, rule_id, label, confidence, value, 'boundary', NULL, NULL FROM split)"""),
        ("found", f"""SELECT rule_id, label, confidence, pass, source, file, line, mtime_ms, value, preview, encoding, paired_secret_preview, paired_access_key_preview,
                paired_other_preview, jwt_expires_at_ms FROM (SELECT *, NULL AS encoding FROM raw_part)
            UNION ALL SELECT rule_id, label, confidence, pass, source, file, line, mtime_ms, value, {O.redact('value')}, encoding, NULL, NULL, NULL, NULL
                FROM extra WHERE suppressed_reason IS NULL
            UNION ALL SELECT rule_id, label, confidence, 'pii', source, file, line, mtime_ms, value, {O.redact('value')}, NULL, NULL, NULL, NULL, NULL FROM personal
            UNION ALL SELECT rule_id, label, confidence, 'injection', source, file, line, mtime_ms, value, {O.redact('value')}, NULL, NULL, NULL, NULL, NULL FROM marks"""),
        ("findings", f"SELECT *, {O.fingerprint('rule_id', 'preview', 'file')} AS fingerprint FROM found"),
    ]


_TABLE_COLS = ("rule_id", "label", "confidence", "pass", "source", "file", "line", "preview", "mtime_ms", "paired_secret_preview",
               "paired_access_key_preview", "paired_other_preview", "jwt_expires_at_ms", "encoding", "fingerprint")


@query(statement(all_findings_ctes(), f"SELECT {', '.join(_TABLE_COLS)} FROM findings"))
def saved_findings(spark, sf_dir):
    return base.findings_table(spark, sf_dir).select(*_TABLE_COLS)


@query(full_scan_sql())
def scan_files(spark, sf_dir):
    return plan.scan_files(base.planted_files(spark, sf_dir)).select(*_SCAN_COLS)


def _as_text_files() -> list[tuple[str, str]]:
    """The default scan with ``lines`` numbered over a file of a hundred documents."""
    out = []
    for name, body in full_scan_ctes():
        if name == "lines":
            out += [("own_lines", body), ("lines", """SELECT 'text' AS source, (file::bigint // 100)::varchar AS file, row_number() OVER (
                PARTITION BY file::bigint // 100 ORDER BY file::bigint, line)::int AS line, text, 0 AS mtime_ms FROM own_lines""")]
        else:
            out.append((name, body))
    return out


@query(statement(_as_text_files(), "SELECT file, line, rule_id, confidence, pass, preview, encoding FROM everything"))
def scan_text_files(spark, sf_dir):
    """Planted documents written as text files, a hundred to a file, and read in splits that are smaller than a file."""
    folder = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    lines = base.planted_lines(spark, sf_dir).withColumn("doc", F.col("file").cast("bigint")).withColumn("bucket", F.floor(F.col("doc") / 100))
    placed = lines.repartition("bucket").sortWithinPartitions("bucket", "doc", "line").select("bucket", F.col("text").alias("value"))
    placed.write.partitionBy("bucket").text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = checkpointed(plan.scan_text_files(spark, folder, "text"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.select(F.regexp_extract("file", r"bucket=(\d+)/", 1).alias("file"), "line", "rule_id", "confidence", "pass", "preview", "encoding")


@query(full_scan_sql())
def scan_records(spark, sf_dir):
    return plan.scan(base.planted_lines(spark, sf_dir)).select(*_SCAN_COLS)
