"""Queries over rules, labels, budgets and session logs, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import context, findings, placement, sessions
from tidemark.operators.context import Rule
from tidemark.plans.review_queries import F0, FC
from tidemark.sources import fixtures as fx
from tidemark.sources import shared
from tidemark.streaming import sessions as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RULES = (
    Rule("g-naming", "global"), Rule("g-off", "global", enabled=False), Rule("r-one", "repo", repos=("acme/r1", "acme/r3")),
    Rule("r-py", "repo", repos=("acme/r2",), paths=("src/**/*.py",)), Rule("p-sql", "path", paths=("**/*.sql",), exclude=("db/migrations/f1*",)),
    Rule("p-docs", "path", paths=("docs/*.md", "deploy/**")), Rule("a-none", "path"),
)


@query(
    rf"""{FC}, c AS (SELECT owner, repo, pr, bool_or(regexp_matches(new_path, '^src/(.*/)?[^/]*\.py$')) AS py,
  bool_or(regexp_matches(new_path, '\.sql$') AND NOT regexp_matches(new_path, '^db/migrations/f1[^/]*$')) AS q,
  bool_or(regexp_matches(new_path, '^docs/[^/]*\.md$') OR starts_with(new_path, 'deploy/')) AS d FROM fx_changes GROUP BY ALL),
r AS (SELECT *, unnest([CASE WHEN repo IN ('r1','r3') THEN 'r-one' END, CASE WHEN repo = 'r2' AND py THEN 'r-py' END, CASE WHEN q THEN 'p-sql' END, CASE WHEN d THEN 'p-docs' END, 'g-naming']) AS rule_id FROM c)
SELECT owner, repo, pr, rule_id, CAST(row_number() OVER (PARTITION BY owner, repo, pr ORDER BY rule_id <> 'g-naming', rule_id) AS INT) AS rank FROM r WHERE rule_id IS NOT NULL"""
)
def selected_rules(spark: SparkSession, d: str) -> DataFrame:
    """JON-16, TOP-4."""
    return context.selected_rules(fx.changes(fx.findings(spark, d)).withColumnRenamed("new_path", "path"), RULES)


@query(SQL["selected_rules"])
def selected_from_many(spark: SparkSession, d: str) -> DataFrame:
    """JON-16 with 5,000 more rules, whose globs begin or end like those that match."""
    more = [Rule(f"x-{k}", "path", paths=(f"src/m{k % 7}/n{k}/**/*.py", f"docs/{k}-*.md", f"**/no{k}.sql")) for k in range(5000)]
    return context.selected_from_many(fx.changes(fx.findings(spark, d)).withColumnRenamed("new_path", "path"), [*RULES, *more])


@query(
    f"""{F0}, {fx.CHANGED_SQL}, {fx.CHANGES_SQL} SELECT c.owner, c.repo, c.pr, c.new_path AS path, CAST(length(c.diff) AS INT) AS n_chars
FROM fx_changes c SEMI JOIN fx_changed w ON w.owner = c.owner AND w.repo = c.repo AND w.pr = c.pr AND w.path = c.new_path"""
)
def diffs_by_path(spark: SparkSession, d: str) -> DataFrame:
    """FLT-18."""
    found = fx.findings(spark, d)
    got = context.diffs_of(fx.changes(found).withColumnRenamed("new_path", "path"), fx.changed_paths(found))
    return got.select("owner", "repo", "pr", "path", F.length("diff").alias("n_chars"))


_LABELS = """WITH l AS (SELECT doc_id, ['feat','Fix ','','docs'][doc_id%4+1] AS pr_type, ['risk/low','risk/high',NULL][doc_id%3+1] AS risk,
  [lang, ' ', source] AS domains, ['risk/low','Feat','custom','test',lang] AS existing, source FROM documents),
s AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(list_concat([pr_type, risk], domains, [source]), lambda x: trim(coalesce(x,''))), lambda x: x <> ''))) AS labels FROM l),
t AS (SELECT *, list_transform(labels, lambda x: lower(x)) AS low, len(list_intersect(list_transform(labels, lambda x: lower(x)), ['feat','fix','refactor','docs','test','chore','perf','ci','security'])) > 0 AS typed FROM s)"""


@query(
    f"""{_LABELS} SELECT doc_id, array_to_string(labels, ',') AS labels, array_to_string(list_filter(existing, lambda x: (starts_with(lower(x), 'risk/')
  OR (typed AND lower(x) IN ('feat','fix','refactor','docs','test','chore','perf','ci','security'))) AND NOT list_contains(low, lower(x))), ',') AS stale FROM t"""
)
def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14."""
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % n + 1).cast("int"))
    docs = fx.table(spark, d, "documents").select(
        "doc_id", pick(("feat", "Fix ", "", "docs"), 4).alias("pr_type"), pick(("risk/low", "risk/high", None), 3).alias("risk_tag"),
        F.array("lang", F.lit(" "), "source").alias("domains"), F.array("source").alias("ownership_hints"),
        F.array(F.lit("risk/low"), F.lit("Feat"), F.lit("custom"), F.lit("test"), "lang").alias("existing"),
    )
    docs = docs.withColumn("labels", context.label_set()).withColumn("stale", context.stale_labels(F.col("existing"), F.col("labels")))
    return docs.select("doc_id", F.array_join("labels", ",").alias("labels"), F.array_join("stale", ",").alias("stale"))


@query(
    f"""{FC.replace("WITH", "WITH RECURSIVE", 1)}, i AS (SELECT owner, repo, pr, ord, new_path, CAST(floor(length(diff) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY owner, repo, pr ORDER BY ord) AS k FROM fx_changes),
w AS (SELECT owner, repo, pr, 0::BIGINT AS k, []::BIGINT[] AS totals, 0 AS chunk FROM (SELECT DISTINCT owner, repo, pr FROM i)
  UNION ALL SELECT i.owner, i.repo, i.pr, i.k, CASE WHEN t.at > 0 THEN totals[1:t.at - 1] || [totals[t.at] + tokens] || totals[t.at + 1:] ELSE totals || [tokens] END, CASE WHEN t.at > 0 THEN t.at - 1 ELSE len(totals) END
  FROM w JOIN i ON i.owner = w.owner AND i.repo = w.repo AND i.pr = w.pr AND i.k = w.k + 1,
    LATERAL (SELECT CASE WHEN tokens <= 5000 THEN coalesce(list_position(list_transform(totals, lambda x: x + tokens <= 5000), true), 0) ELSE 0 END AS at) t)
SELECT i.owner, i.repo, i.pr, i.ord, new_path, tokens, CAST(chunk AS INT) AS chunk FROM w JOIN i ON i.owner = w.owner AND i.repo = w.repo AND i.pr = w.pr AND i.k = w.k"""
)
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-3: a change set's files in chunks of 5000 tokens."""
    items = fx.changes(fx.findings(spark, d)).select("owner", "repo", "pr", "ord", "new_path", (F.length("diff") / 4).cast("long").alias("tokens"))
    return context.first_fit(items, 5000, "owner", "repo", "pr")


@query(
    f"""{FC} SELECT owner, repo, pr, CAST(list_reduce(list_prepend(0, list(length(diff) ORDER BY ord)), lambda a, x: CASE WHEN a + x <= 30000 THEN a + x ELSE a END) AS BIGINT) AS used FROM fx_changes GROUP BY ALL
HAVING min(length(diff)) <= 30000"""
)
def budgeted_items(spark: SparkSession, d: str) -> DataFrame:
    """WIN-5b: bytes that the accepted diffs of a change set take."""
    items = fx.changes(fx.findings(spark, d)).select("owner", "repo", "pr", "ord", F.length("diff").cast("long").alias("n_bytes"))
    return context.fitting_items(items, 30000, "owner", "repo", "pr").groupBy("owner", "repo", "pr").agg(F.sum("n_bytes").alias("used"))


def _session_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines_of(fx.table(spark, d, "events"))


def _lines_of(e: DataFrame, *keep: str) -> DataFrame:
    """Log lines from ``events``: a session a user; one kind of record in six doesn't parse."""
    kind, k = F.col("event_id") % 6, F.get_json_object("props", "$.k").cast("long")
    when = lambda n, c: F.when(kind == n, c)
    kinds = ("llm_response", "tool_call", "llm_error", "review_item_done", "session_end")
    rec = F.struct(
        F.element_at(F.array(*[F.lit(x) for x in (*kinds, "")]), (kind + 1).cast("int")).alias("type"),
        F.col("user_id").cast("string").alias("sessionId"), when(1, F.concat(F.lit("f"), k.cast("string"))).alias("filePath"),
        when(1, F.col("event_type")).alias("tool_name"), when(1, F.col("value") >= 10).alias("ok"),
        when(3, F.concat(F.lit("p"), (k % 5).cast("string"))).alias("fingerprint"), when(3, F.col("event_type")).alias("comments"),
        when(0, F.struct(k.alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), F.nullif(k % 7, F.lit(0)).alias("cache_read_tokens"))).alias("usage"),
    )
    return e.select(*keep, F.col("event_id").alias("line_no"), F.when(kind == 5, '{"type": "tool_call", ').otherwise(F.to_json(rec)).alias("value"))


_SESSIONS = """WITH e AS (SELECT *, CAST(user_id AS VARCHAR) AS session, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, event_id%6 AS kind FROM events WHERE event_id%6 <> 5)"""


@query(
    f"""{_SESSIONS} SELECT session, CAST(coalesce(sum(k) FILTER (kind=0),0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(event_id%50) FILTER (kind=0),0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(k%7) FILTER (kind=0),0) AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_write_tokens, count(*) FILTER (kind=2) AS llm_failures, count(*) FILTER (kind=1) AS tool_calls,
  count(*) FILTER (kind=1 AND value < 10) AS tool_failures, CAST(count(DISTINCT k) FILTER (kind=1) AS INT) AS n_files, count(*) FILTER (kind=4) > 0 AS closed FROM e GROUP BY 1"""
)
def session_usage(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5, AGG-16."""
    return sessions.usage_totals(sessions.records(_session_lines(spark, d)))


@query(SQL["session_usage"].replace("GROUP BY 1", "GROUP BY 1 HAVING closed"))
def closed_session_usage(spark: SparkSession, d: str) -> DataFrame:
    """STR-2: a stream over the events yields each session when it ends."""
    events = fx.table(spark, d, "events")
    arriving = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    recs = sessions.records(_lines_of(arriving.withColumn("event_time", F.col("ts").cast("timestamp")), "event_time"))
    out, checkpoint = shared.new_folder(spark, "closed"), shared.new_folder(spark, "closed-checkpoint")
    done = streams.closed_sessions(recs)
    done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(out).where("closed")


@query(f"{_SESSIONS} SELECT session, event_type AS tool_name, count(*) AS n_calls FROM e WHERE kind = 1 GROUP BY ALL")
def session_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tool_counts(sessions.records(_session_lines(spark, d)))


@query(
    f"""{_SESSIONS}, c AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY event_id) AS INT) AS call_no FROM e WHERE kind = 1)
SELECT session, call_no, event_type AS tool_name, 'f'||k AS file_path FROM c WHERE value < 10"""
)
def session_tool_failures(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tool_failures(sessions.records(_session_lines(spark, d))).drop("arguments", "error")


@query(f"{_SESSIONS} SELECT session, 'p'||(k%5) AS fingerprint, arg_max(event_type, event_id) AS comments FROM e WHERE kind = 3 GROUP BY ALL")
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11."""
    return sessions.resume_items(sessions.records(_session_lines(spark, d)))


# --- quoted code ---------------------------------------------------------------------------------


def _quoted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ten documents are a change set; lines of a file are hunks of twenty; findings quote two lines of their file or of the next."""
    docs = fx.table(spark, d, "documents").select(
        F.lit("acme").alias("owner"), F.lit("r").alias("repo"), F.expr("doc_id div 10").alias("pr"), F.col("doc_id").alias("change_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"),
    )
    changes = docs.select("owner", "repo", "pr", "change_id", F.col("path").alias("new_path"), F.concat(F.lit("old/"), "path").alias("old_path"), F.col("change_id").alias("ord"))
    lines = docs.select("owner", "repo", "pr", "change_id", F.posexplode(F.split("content", "\n")).alias("k", "content"))
    kind = F.when(F.col("k") % 5 == 0, "deleted").otherwise("added")
    hunks = lines.select("owner", "repo", "pr", "change_id", F.expr("k div 20").alias("hunk_no"), F.col("k").alias("pos"), kind.alias("type"), "content", (F.col("k") + 1).alias("old_line"), (F.col("k") + 1).alias("new_line"))
    of = F.when(F.col("change_id") % 3 == 0, F.col("change_id") + 1).otherwise(F.col("change_id"))
    at = (F.col("change_id") % 4).cast("int")
    quote = docs.select(F.col("change_id").alias("q"), F.split("content", "\n").alias("l"))
    f = docs.join(quote, of == F.col("q"))
    f = f.select(
        F.col("change_id").alias("finding_id"), "owner", "repo", "pr", "path", F.array_join(F.slice("l", at + 1, 2), "\n").alias("existing_code"),
        F.when(F.col("change_id") % 11 == 0, 5).otherwise(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"),
    )
    return f, changes, hunks, docs


_NORM = r"regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^\+?-?', ''), '^\s+|\s+$', '', 'g')"


@query(
    rf"""WITH d AS (SELECT doc_id, doc_id//10 AS pr, string_split(coalesce(text,''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, pr, unnest(range(0, len(l))) AS k, {_NORM.format("unnest(l)")} AS s FROM d),
lines AS (SELECT doc_id, pr, CASE WHEN k%5=0 THEN 2 ELSE 1 END AS stage, k//20 AS hunk, k+1 AS n, s FROM x UNION ALL SELECT doc_id, pr, 3, 0, k+1, s FROM x WHERE s <> ''),
seg AS (SELECT doc_id, pr, stage, hunk, list(s ORDER BY n) AS ss, list(n ORDER BY n) AS ns FROM lines GROUP BY ALL),
f AS (SELECT a.doc_id AS finding_id, a.pr, list_filter(list_transform(b.l[a.doc_id%4+1 : a.doc_id%4+2], lambda x: {_NORM.format("x")}), lambda x: x <> '') AS t,
  CASE WHEN a.doc_id%11=0 THEN 5 ELSE 0 END AS given FROM d a JOIN d b ON b.doc_id = CASE WHEN a.doc_id%3=0 THEN a.doc_id+1 ELSE a.doc_id END),
h AS (SELECT f.finding_id, s.doc_id, stage, hunk, ns, len(t) AS m, list_filter(range(1, len(ss)-len(t)+2), lambda i: ss[i:i+len(t)-1] = t)[1] AS i
  FROM f JOIN seg s ON s.pr = f.pr WHERE len(t) > 0 AND given = 0 AND list_contains(ss, t[1])),
one AS (SELECT finding_id, doc_id, arg_min(ns[i], stage*1000000+hunk) AS a, arg_min(ns[i+m-1], stage*1000000+hunk) AS b FROM h WHERE i IS NOT NULL GROUP BY ALL),
g AS (SELECT finding_id, max(a) FILTER (doc_id = finding_id) AS oa, max(b) FILTER (doc_id = finding_id) AS ob, count(*) FILTER (doc_id <> finding_id) AS n,
  max(doc_id) FILTER (doc_id <> finding_id) AS od, max(a) FILTER (doc_id <> finding_id) AS xa, max(b) FILTER (doc_id <> finding_id) AS xb FROM one GROUP BY 1)
SELECT finding_id, 'f'||CASE WHEN oa IS NULL AND n = 1 THEN od ELSE finding_id END AS path, CAST(coalesce(oa, CASE WHEN n=1 THEN xa END, given) AS BIGINT) AS start_line,
  CAST(coalesce(ob, CASE WHEN n=1 THEN xb END, 0) AS BIGINT) AS end_line, CASE WHEN oa IS NOT NULL THEN 'own' WHEN n=1 THEN 'moved' WHEN given > 0 THEN 'given' ELSE 'none' END AS placed_by
FROM f LEFT JOIN g USING (finding_id)"""
)
def placed_findings(spark: SparkSession, d: str) -> DataFrame:
    """JON-12, JON-13."""
    f, changes, hunks, docs = _quoted(spark, d)
    out = placement.placed(f, changes, placement.side_lines(hunks, docs))
    return out.select("finding_id", "path", "start_line", "end_line", "placed_by")


def _run_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log files from ``events``: a file a user, kinds of lines by event_id."""
    e = fx.table(spark, d, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    stamp = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("Z"))
    s = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    line = (
        F.when(i % 9 == 0, s('{"stage":"metrics","time":"', stamp, '","duration_ms":', k * 3, ',"files_reviewed":', i % 4, ',"prompt_tokens":', k, "}"))
        .when(i % 9 == 1, s("now [tool] metrics: duration=", k, "ms files=", i % 3, " tokens=in:", k, "/out:7 cost=$0.5 findings=new:", i % 5, "/carried:x"))
        .when(i % 9 == 2, s('{"type":"session_start","timestamp":"', stamp, '"}'))
        .when(i % 9 == 3, s('{"type":"session_end","files_reviewed":', i % 6, ',"duration_seconds":', k % 3, ".5}"))
        .when(i % 9 == 4, '{"stage":"metrics", broken').otherwise("other")
    )
    return e.select(F.col("user_id").alias("file"), i.alias("line_no"), line.alias("value"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("modified"))


@query(
    """WITH e AS (SELECT user_id AS file, event_id AS i, event_id%9 AS kind, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events WHERE event_id%9 < 4),
g AS (SELECT file, max(i) FILTER (kind < 2) AS at, arg_max(CASE kind WHEN 0 THEN k*3 ELSE k END, i) FILTER (kind < 2) AS ms, arg_max(CASE kind WHEN 0 THEN i%4 ELSE i%3 END, i) FILTER (kind < 2) AS nf,
  arg_max(k, i) FILTER (kind < 2) AS p, arg_max(CASE kind WHEN 0 THEN 0 ELSE 7 END, i) FILTER (kind < 2) AS c, arg_max(CASE kind WHEN 0 THEN 0 ELSE i%5 END, i) FILTER (kind < 2) AS nw,
  arg_max(i%60, i) FILTER (kind = 2) AS st, arg_min(i%60, i) FILTER (kind = 0) AS lg FROM e GROUP BY 1),
x AS (SELECT g.file, arg_min(e.i%6, e.i) FILTER (e.i%6 <> 0) AS ef, arg_min(k%3*1000+500, e.i) AS em FROM g JOIN e ON e.file = g.file AND e.kind = 3 AND e.i > coalesce(g.at,-1) GROUP BY 1)
SELECT file, strftime(CASE WHEN coalesce(st, lg) IS NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-01-01' + to_seconds(coalesce(st, lg)) END, '%Y-%m-%d %H:%M:%S') AS ts,
  CAST(coalesce(nullif(ms,0), em, 0) AS BIGINT) AS duration_ms, CAST(coalesce(nullif(nf,0), ef, 0) AS BIGINT) AS files_reviewed, CAST(coalesce(p,0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(c,0) AS BIGINT) AS completion_tokens, CAST(coalesce(nw,0) AS BIGINT) AS new_findings FROM g LEFT JOIN x USING (file)"""
)
def run_log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-6, FUN-9."""
    m = sessions.run_metrics(_run_logs(spark, d))
    return m.select("file", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "duration_ms", "files_reviewed", "prompt_tokens", "completion_tokens", "new_findings")


@query(
    rf"""{F0} SELECT owner, repo, pr, '| Tool | Rule | Location | Finding |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || substr(source, 9) || ' | ' || category || ' | `' || path || ':' || start_line || '` | ' || content || ' |' || chr(10), '' ORDER BY ord) AS "table"
FROM fx_findings WHERE starts_with(source, 'scanner:') GROUP BY ALL"""
)
def scanner_tables(spark: SparkSession, d: str) -> DataFrame:
    """FUN-14."""
    return findings.scanner_table(fx.findings(spark, d), "owner", "repo", "pr")
