"""Audits of tool calls and configuration files.

Configurations are one row per file: ``file STRING, content STRING``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.catalog import paths as P
from lodesieve.catalog.advisories import ADVISORIES, ADVISORY_SCHEMA
from lodesieve.catalog.rules import HIGH_RULES
from lodesieve.functions.json_nodes import nodes, parse
from lodesieve.functions.regex import to_java
from lodesieve.functions.text import INVISIBLE_CHARS, basename, bind, version_triple
from lodesieve.operators.injection import code_point_name, suspicious_invisibles
from lodesieve.operators.redact import first_hit, redacted, safe_preview

INTEGRITY_COLUMNS = ("severity", "kind", "file", "detail")


def sensitive_path_label(text: Column) -> Column:
    """Label of the first sensitive path a command or path mentions, else NULL."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in P.SENSITIVE_PATHS:
        out = out.when(text.rlike(to_java(pattern, ignore_case=True, exact_edges=True)), F.lit(label))
    return out


def audit_sensitive_paths(calls: DataFrame) -> DataFrame:
    """Add ``blocked`` and ``label`` to tool calls (``tool, command, file_path``).

    Only shell and read calls are looked at; a call without input is never blocked.
    """
    target = F.when(F.col("tool") == "Bash", F.col("command")).when(F.col("tool") == "Read", F.col("file_path"))
    return (calls.withColumn("label", sensitive_path_label(target))
            .withColumn("blocked", F.col("label").isNotNull()))


def flag_prompts(conversations: DataFrame, role: str = "user") -> DataFrame:
    """User prompts that hold a credential: the first hit in rule order.

    Only the first match of each rule is considered, as a prompt is checked once.
    """
    hit = first_hit(F.col("text"), HIGH_RULES, first_match_only=True)
    return (conversations.where(F.col("role") == role).withColumn("_h", hit).where(F.col("_h").isNotNull())
            .select("conv_id", "turn", F.col("_h.label").alias("label"), F.col("_h.preview").alias("preview")))


def redact_tool_outputs(results: DataFrame) -> DataFrame:
    """Mask secrets in ``stdout`` and ``stderr`` of shell results; ``act`` says whether anything was masked."""
    is_shell = F.col("tool") == "Bash"
    out = F.coalesce(first_hit(F.col("stdout")), first_hit(F.col("stderr")))
    return (results.withColumn("_h", F.when(is_shell, out))
            .withColumn("act", F.col("_h").isNotNull())
            .withColumn("label", F.col("_h.label")).withColumn("preview", F.col("_h.preview"))
            .withColumn("stdout", F.when(F.col("act"), redacted(F.coalesce("stdout", F.lit("")))).otherwise(F.col("stdout")))
            .withColumn("stderr", F.when(F.col("act"), redacted(F.coalesce("stderr", F.lit("")))).otherwise(F.col("stderr")))
            .drop("_h"))


def _hooks_of(text: str | None) -> list[dict]:
    config = parse(text)
    root = config.get("hooks") if isinstance(config, dict) else None

    def inherit(note, parent, key):
        event, matcher, inside_command = note
        if parent is root:
            return key, None, False
        own = parent.get("matcher") if isinstance(parent, dict) else None
        return event, own if isinstance(own, str) else matcher, inside_command or key == "command"

    found = []
    for value, (event, matcher, inside_command) in nodes(root, (None, None, False), inherit):
        if isinstance(value, dict) and value is not root and not inside_command and "command" in value:
            own, command = value.get("matcher"), value["command"]
            text_command = isinstance(command, str)
            found.append({"event": event, "matcher": own if isinstance(own, str) else matcher, "command": command if text_command else None,
                          "state": "command" if text_command else "unrecognized"})
    return found


_HOOKS = "array<struct<event:string,matcher:string,command:string,state:string>>"


def explode_hooks(configs: DataFrame) -> DataFrame:
    """Every ``command`` below ``hooks``, at any depth, with its event and inherited matcher.

    A command that is not text is ``unrecognized``.  Neither depth nor size is
    bounded, so the walk is a small vectorised function, linear in the file; only
    files that mention hooks reach it.
    """
    @F.pandas_udf(_HOOKS)
    def hooks(contents: pd.Series) -> pd.Series:
        return contents.map(_hooks_of)

    gated = configs.where(F.contains("content", F.lit('"hooks"')))
    return (gated.select("file", F.explode(hooks(F.col("content"))).alias("h")).select("file", "h.*"))


def hook_verdict(command: Column, home: str | None = None) -> Column:
    """Struct ``(signature, severity)`` of the first signature a hook command shows, else NULL.

    A script in a dot-directory below ``home`` is the documented layout and only
    worth a note.
    """
    def matches(pattern: str, ignore_case: bool = False) -> Column:
        return command.rlike(to_java(pattern, ignore_case, exact_edges=True))

    def verdict(signature: str, severity: Column | str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(signature).alias("signature"), level.alias("severity"))

    in_dot_dir = matches(P.SCRIPT_RUNNER) & matches(P.DOT_DIR_SCRIPT)
    level: Column | str = "warn"
    if home is not None:
        quoted = "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in home)
        anchored = to_java(f"(?:~|{quoted})" + P.HOME_DOT_DIR_SCRIPT, exact_edges=True)
        bare = F.regexp_replace(command, anchored, "")
        level = F.when(bare.rlike(to_java(P.DOT_DIR_SCRIPT, exact_edges=True)), "warn").otherwise("info")
    return (F.when(matches(P.DROPPER_NAME, True), verdict("dropper-name", "warn"))
            .when(matches(P.DOWNLOAD_TO_SHELL, True), verdict("curl-pipe-sh", "warn"))
            .when(matches(P.BASE64_DECODE), verdict("base64-decode", "warn"))
            .when(in_dot_dir, verdict("script-in-dot-dir", level)))


def classify_hook_command(hooks: DataFrame, home: str | None = None) -> DataFrame:
    """Add ``signature`` and ``severity``; an unsuspicious hook is a note without signature."""
    df = hooks.withColumn("_v", hook_verdict(F.col("command"), home))
    return (df.withColumn("signature", F.col("_v.signature"))
            .withColumn("severity", F.coalesce("_v.severity", F.lit("info"))).drop("_v"))


def _integrity(severity: Column | str, kind: Column | str, detail: Column | str) -> Column:
    """One integrity finding; a file's findings form one array, so its table is read once."""
    values = [F.lit(x) if isinstance(x, str) else x for x in (severity, kind, detail)]
    return F.struct(*(v.alias(n) for v, n in zip(values, ("severity", "kind", "detail"), strict=True)))


def _listed(rows: DataFrame, *found: Column) -> DataFrame:
    """Integrity findings of ``rows``: each argument is a struct, NULL where there is none."""
    some = F.filter(F.array(*found), lambda f: f.isNotNull())
    return rows.select("file", F.explode(some).alias("f")).select("f.severity", "f.kind", "file", "f.detail")


def audit_hooks(configs: DataFrame, home: str | None = None) -> DataFrame:
    """Integrity findings of hook configurations, from one read of their table."""
    hooks = F.pandas_udf(lambda contents: contents.map(_hooks_of), _HOOKS)
    valid = F.try_parse_json(F.col("content")).isNotNull()
    seen = configs.select("file", "content", valid.alias("_valid")).where(~F.col("_valid") | F.contains("content", F.lit('"hooks"')))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("event"), none.alias("matcher"), F.col("content").alias("command"), F.lit("broken").alias("state")))
    walked = hooks(F.when(F.col("_valid"), F.col("content")))
    rows = seen.withColumn("_walked", walked).select("file", F.explode(F.when(F.col("_valid"), F.col("_walked")).otherwise(whole)).alias("h")).select("file", "h.*")
    rows = rows.withColumn("_v", hook_verdict(F.col("command"), home))
    where = F.concat(safe_preview(F.coalesce("event", F.lit("unknown event")), 40),
                     F.coalesce(F.concat(F.lit(" ("), safe_preview(F.col("matcher"), 40), F.lit(")")), F.lit("")))
    said = F.concat(where, F.lit(": "), F.coalesce("_v.signature", F.lit("runs automatically")), F.lit(": "), safe_preview(F.col("command")))
    state = F.col("state")
    return _listed(
        rows,
        F.when(state == "command", _integrity(F.coalesce("_v.severity", F.lit("info")), "hook", said)),
        F.when(state == "unrecognized", _integrity("info", "hook-unrecognized", where)),
        F.when(state == "broken", _integrity("warn", "unparseable-config", "not valid JSON; the text was checked for signatures instead")),
        F.when((state == "broken") & F.col("_v").isNotNull(), _integrity(F.col("_v.severity"), "hook", F.concat(F.lit("signature in raw text: "), F.col("_v.signature")))))


# Comments and strings in one alternation, so that a comment mark inside a string stays.
_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'


def strip_json_comments(text: Column) -> Column:
    """JSON with comments and trailing commas to plain JSON; strings are left alone."""
    no_comments = F.regexp_replace(text, rf"({_STRING})|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?", "$1")
    return F.regexp_replace(no_comments, rf"({_STRING})|,(?=[ \t\r\n]*+[\]}}])", "$1")


def _autorun_names(text: str | None) -> list[str]:
    below = (v for v, _ in nodes(parse(text), None, lambda note, parent, key: None))
    auto = (v for v in below if isinstance(v, dict) and isinstance(v.get("runOptions"), dict) and v["runOptions"].get("runOn") == "folderOpen")
    names = (v.get("label") or v.get("command") or v.get("script") for v in auto)
    return [n if isinstance(n, str) else "(unnamed task)" for n in names]


def find_autorun_tasks(configs: DataFrame) -> DataFrame:
    """Tasks that run when a folder is opened, ``(file, task, parsed)``.

    Text that is not JSON even without comments falls back to a raw signature.
    """
    @F.pandas_udf("array<string>")
    def tasks(contents: pd.Series) -> pd.Series:
        return contents.map(_autorun_names)

    gated = configs.where(F.contains("content", F.lit("folderOpen"))).withColumn("_plain", strip_json_comments(F.col("content")))
    parsed = F.try_parse_json("_plain").isNotNull()
    found = gated.where(parsed).select("file", F.explode(tasks(F.col("_plain"))).alias("task"), F.lit(True).alias("parsed"))
    raw = gated.where(~parsed & F.col("content").rlike(r'"runOn"\s*+:\s*+"folderOpen"'))
    return found.unionByName(raw.select("file", F.lit("(unparsed file)").alias("task"), F.lit(False).alias("parsed")))


def explode_servers(configs: DataFrame, keep_broken: bool = False) -> DataFrame:
    """Server definitions of tool-server configurations: ``file, server, command, args, url``.

    With ``keep_broken`` a file that is not JSON is one row whose ``broken`` is true.
    """
    parsed = F.try_parse_json(F.col("content"))
    servers = F.try_variant_get(parsed, "$.mcpServers", "map<string,variant>")
    definition = F.col("definition")

    def text(path: str) -> Column:
        raw = F.try_variant_get(definition, path, "variant")
        return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(definition, path, "string"))

    raw_args = F.coalesce(F.try_variant_get(definition, "$.args", "array<variant>"), F.array().cast("array<variant>"))
    args = F.transform(F.filter(raw_args, lambda a: F.schema_of_variant(a) == "STRING"),
                       lambda a: F.try_variant_get(a, "$", "string"))
    broken = parsed.isNull() if keep_broken else F.lit(False)
    rows = (configs.where(F.contains("content", F.lit("mcpServers")) | broken)
            .select("file", broken.alias("broken"), F.explode_outer(servers).alias("server", "definition"))
            .where(F.col("broken") | F.schema_of_variant("definition").startswith("OBJECT"))
            .select("file", "server", text("$.command").alias("command"), args.alias("args"), text("$.url").alias("url"), "broken"))
    return rows if keep_broken else rows.drop("broken")


def _pinned(arg: Column) -> tuple[Column, Column, Column]:
    """Ecosystem, package and version of an argument that pins a package, else NULL."""
    npm, pip = to_java(P.NPM_PIN), to_java(P.PIP_PIN)

    def group(n: int) -> Column:
        return F.when(arg.rlike(npm), F.regexp_extract(arg, npm, n)).when(arg.rlike(pip), F.regexp_extract(arg, pip, n))

    return F.when(arg.rlike(npm), "npm").when(arg.rlike(pip), "pip"), group(1), group(2)


def pinned_packages(servers: DataFrame) -> DataFrame:
    """Packages with a version among the arguments: ``file, server, ecosystem, package, version``."""
    ecosystem, package, version = _pinned(F.col("arg"))
    return (servers.select("file", "server", F.explode("args").alias("arg"))
            .select("file", "server", ecosystem.alias("ecosystem"), package.alias("package"), version.alias("version"))
            .where(F.col("ecosystem").isNotNull()))


def with_version(packages: DataFrame) -> DataFrame:
    """Add ``version_triple``; NULL means that the version cannot be judged."""
    return packages.withColumn("version_triple", version_triple(F.col("version")))


def advisory_table(spark: SparkSession) -> DataFrame:
    """The known-vulnerable versions of this package, a fixed number of rows and safe to broadcast."""
    return F.broadcast(spark.createDataFrame(ADVISORIES, ADVISORY_SCHEMA))


def in_range(v: Column, r: Column) -> Column:
    """Is a version triple inside a range?  An open end does not bound it."""
    low, high, below = version_triple(r["lowest"]), version_triple(r["highest"]), version_triple(r["below"])
    return F.coalesce(v >= low, F.lit(True)) & F.coalesce(v <= high, F.lit(True)) & F.coalesce(v < below, F.lit(True))


def match_advisories(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages in a vulnerable range.

    An equi-join on (ecosystem, package) with the ranges as a residual test; a
    version that cannot be parsed never matches and stays visible as such in
    ``with_version``.
    """
    v = F.col("version_triple")
    joined = with_version(packages).where(v.isNotNull()).join(advisories, ["ecosystem", "package"])
    return joined.where(F.exists("ranges", lambda r: in_range(v, r))).drop("ranges", "version_triple")


def is_insecure_url(url: Column) -> Column:
    """Plain HTTP to a host that is not this machine."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(url.rlike(r"(?i)\Ahttp:") & host.isNotNull() & ~host.isin(*P.LOOPBACK_HOSTS), F.lit(False))


def audit_mcp_servers(configs: DataFrame, advisories: DataFrame) -> DataFrame:
    """Integrity findings of tool-server configurations, from one read of their table.

    Known-vulnerable pinned versions, plain-HTTP endpoints and downloads piped to
    a shell are warnings; so is a file that is not JSON.  Advisories are grouped by
    package first, so the join never multiplies arguments.
    """
    known = advisories.groupBy("ecosystem", "package").agg(F.collect_list(F.struct("advisory_id", "ranges")).alias("advisories"))
    servers = explode_servers(configs, keep_broken=True)
    line = F.array_join(F.concat(F.filter(F.array("command"), lambda c: c.isNotNull()), F.col("args")), " ")
    args = servers.select("file", "server", "url", "broken", line.alias("line"), F.posexplode_outer("args").alias("at", "arg"))
    ecosystem, package, version = _pinned(F.col("arg"))
    joined = args.withColumns({"ecosystem": ecosystem, "package": package, "version": version}).join(known, ["ecosystem", "package"], "left")
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    name, triple = safe_preview(F.col("server"), 60), version_triple(F.col("version"))
    hits = F.filter("advisories", lambda a: triple.isNotNull() & F.exists(a["ranges"], lambda r: in_range(triple, r)))
    cves = F.transform(F.coalesce(hits, F.array().cast(joined.schema["advisories"].dataType)), lambda a: _integrity(
        "warn", "mcp-known-cve", F.concat(name, F.lit(": "), F.col("package"), F.lit("@"), F.col("version"), F.lit(" "), a["advisory_id"])))
    piped = F.col("line").rlike(to_java(P.SERVER_DOWNLOAD_TO_SHELL, ignore_case=True, exact_edges=True))
    single = F.array(
        F.when(first & is_insecure_url(F.col("url")), _integrity("warn", "mcp-insecure-transport", F.concat(name, F.lit(": "), safe_preview(F.col("url"), 80)))),
        F.when(first & piped, _integrity("warn", "mcp-curl-pipe-shell", F.concat(name, F.lit(": "), safe_preview(F.col("line"))))),
        F.when(first & F.col("broken"), _integrity("warn", "unparseable-config", "not valid JSON")))
    found = F.concat(F.filter(single, lambda f: f.isNotNull()), cves)
    return joined.select("file", F.explode(found).alias("f")).select("f.severity", "f.kind", "file", "f.detail")


def audit_rules_files(files: DataFrame) -> DataFrame:
    """Integrity findings of agent rule files and of scripts in agent directories (``file, content``), from one read.

    Known dropper names and suspicious invisible characters are warnings; loose
    scripts, loaded rule files and script joiners next to non-ASCII text are notes.
    """
    name = F.lower(basename(F.col("file")))
    path = F.concat(F.lit("/"), "file")
    top_level_script = path.rlike(r"/\.claude/[^/]+\z") & name.rlike(r"\.(?:mjs|cjs|js)\z")
    cursor_rule = path.rlike(r"/\.cursor/rules/[^/]+\z")
    dropper = ((top_level_script | path.rlike(r"/\.vscode/[^/]+\z")) & (name == "setup.mjs")) | (cursor_rule & (name == "setup.mdc"))
    hidden = (cursor_rule | name.isin("claude.md", ".cursorrules")) & F.col("content").rlike(INVISIBLE_CHARS)

    def characters(severity: str, suspicious: bool) -> Column:
        shown = F.when(hidden, invisibles_with_lines(F.col("content"), suspicious))
        return bind(shown, lambda found: F.when(F.size(found) > 0, _integrity(severity, "zero-width", summarize_with_lines(found))))

    return _listed(
        files,
        F.when(dropper, _integrity("warn", "dropper-name", "file name of a known dropper")),
        F.when(top_level_script & ~dropper, _integrity("info", "loose-script", "script in an agent directory")),
        F.when(cursor_rule & ~dropper, _integrity("info", "cursor-rule", "loaded as agent instructions")),
        characters("warn", True), characters("info", False))


# Script joiners next to a character outside ASCII, as emoji and several scripts need them.
_JOINERS = r"(?<=[^\x00-\x7F])[\x{200C}\x{200D}]|[\x{200C}\x{200D}](?=[^\x00-\x7F])"


def invisibles_with_lines(content: Column, suspicious: bool) -> Column:
    """Array of ``(char, line)`` of a whole file, computed inside its row.

    A byte-order mark at the very start of the file is not reported.
    """
    def in_line(text: Column, i: Column) -> Column:
        # The leading blank keeps a mark at the start of a later line from looking like the file's.
        shown = F.when(i == 0, text).otherwise(F.concat(F.lit(" "), text))
        found = suspicious_invisibles(shown) if suspicious else F.regexp_extract_all(shown, F.lit(_JOINERS), F.lit(0))
        return F.transform(found, lambda c: F.struct(c.alias("char"), (i + 1).alias("line")))

    return F.flatten(F.transform(F.split(content, "\n", -1), in_line))


def summarize_with_lines(found: Column) -> Column:
    """``U+200B ×3 (lines 1, 4); ...`` with all lines of each character."""
    def one(char: Column) -> Column:
        mine = F.filter(found, lambda f: f["char"] == char)
        lines = F.array_distinct(F.transform(mine, lambda f: f["line"]))
        return F.concat(code_point_name(char), F.lit(" ×"), F.size(mine).cast("string"),
                        F.when(F.size(lines) == 1, " (line ").otherwise(" (lines "),
                        F.array_join(lines.cast("array<string>"), ", "), F.lit(")"))

    return F.array_join(F.transform(F.array_distinct(F.transform(found, lambda f: f["char"])), one), "; ")
