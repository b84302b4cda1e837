"""Queries over diffs, scanner reports, SARIF, the finding store and index maintenance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import findings, index, overlap, sarif, scoring
from tidemark.operators.scoring import KEY
from tidemark.plans.graph_queries import PAIRS
from tidemark.plans.review_queries import F0, FP_SQL, FS
from tidemark.sources import diffs, reports, shared, store
from tidemark.sources import fixtures as fx
from tidemark.streaming import continuous

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- diffs ---------------------------------------------------------------------------------------

#: One diff an order, one file a line: new, deleted, renamed, binary or edited by its number; a hunk of x added, y deleted lines.
_DIFF_SQL = """WITH r AS (SELECT l_orderkey AS diff_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS file_no,
  l_partkey AS pk, l_suppkey % 4 AS x, l_partkey % 3 AS y, (l_partkey + l_suppkey) % 5 AS kind FROM lineitem)
"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = lambda c: c.cast("string")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    r = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("diff_id"), F.row_number().over(w).alias("file_no"), F.col("l_partkey").alias("pk"), (F.col("l_suppkey") % 4).cast("int").alias("x"),
        (F.col("l_partkey") % 3).cast("int").alias("y"), ((F.col("l_partkey") + F.col("l_suppkey")) % 5).alias("kind"),
    )
    name, pk = F.concat(F.lit("src/f"), s(F.col("file_no")), F.lit(".go")), s(F.col("pk"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), F.when(F.col("kind") == 2, F.concat(F.lit("moved/"), name)).otherwise(name), F.lit("\n"))
    more = (
        F.when(F.col("kind") == 0, "new file mode 100644\nindex 000..111\n").when(F.col("kind") == 1, "deleted file mode 100644\nindex 111..000\n")
        .when(F.col("kind") == 2, F.concat(F.lit("similarity index 90%\nrename from old/"), name, F.lit("\nrename to moved/"), name, F.lit("\n")))
        .when(F.col("kind") == 3, "Binary files a/x and b/x differ\n").otherwise("index 1..2\n--- a/x\n+++ b/x\n")
    )
    hunk = F.concat(F.lit("@@ -"), pk, F.lit(",9 +"), s(F.col("pk") + 2), F.lit(",9 @@ func\n ctx\n"), F.repeat(F.lit("+++i\n"), F.col("x")), F.repeat(F.lit("-old\n"), F.col("y")), F.lit(" end\n\\ No newline at end of file\n"))
    r = r.withColumn("part", F.concat(head, more, F.when(F.col("kind") == 3, "").otherwise(hunk)))
    g = r.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("file_no", "part"))).alias("p"))
    return g.select("diff_id", F.array_join(F.transform("p", lambda v: v["part"]), "").alias("text"))


@query(
    _DIFF_SQL + """SELECT diff_id, CAST(file_no AS BIGINT) AS file_no, CASE WHEN kind = 2 THEN 'old/' ELSE '' END||'src/f'||file_no||'.go' AS old_path,
CASE kind WHEN 1 THEN '/dev/null' WHEN 2 THEN 'moved/src/f'||file_no||'.go' ELSE 'src/f'||file_no||'.go' END AS new_path, kind = 0 AS is_new, kind = 1 AS is_deleted,
false AS is_binary, kind = 2 AS is_renamed, CASE WHEN kind = 3 THEN 0 ELSE x END AS insertions, CASE WHEN kind = 3 THEN 0 ELSE y END AS deletions FROM r""".replace(
        "false AS is_binary", "kind = 3 AS is_binary"
    )
)
def diff_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1: files of unified diffs."""
    return diffs.file_changes(_diffs(spark, d)).drop("diff")


@query(
    _DIFF_SQL + """, h AS (SELECT * FROM r WHERE kind <> 3),
l AS (SELECT diff_id, file_no, pk, 0 AS k, 'context' AS type, 'ctx' AS content, 0 AS o, 0 AS n FROM h
  UNION ALL SELECT diff_id, file_no, pk, k, 'added', '++i', NULL, k FROM h, unnest(range(1, x + 1)) t(k)
  UNION ALL SELECT diff_id, file_no, pk, 10 + k, 'deleted', 'old', k, NULL FROM h, unnest(range(1, y + 1)) t(k)
  UNION ALL SELECT diff_id, file_no, pk, 99, 'context', 'end', y + 1, x + 1 FROM h)
SELECT diff_id, CAST(file_no AS BIGINT) AS file_no, type, content, coalesce(CAST(pk + o AS INT), -1) AS old_line, coalesce(CAST(pk + 2 + n AS INT), -1) AS new_line FROM l"""
)
def diff_hunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: numbered hunk lines."""
    got = diffs.hunk_lines(_diffs(spark, d)).where("not (content = '' and type = 'context')")
    line = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return got.select("diff_id", "file_no", "type", "content", line("old_line"), line("new_line"))


# --- scanner reports -----------------------------------------------------------------------------


def _reports(spark: SparkSession, d: str, entry) -> DataFrame:
    """One JSON array of ``entry`` structs a change set, from the scanner findings."""
    f = fx.findings(spark, d).where(F.col("source").startswith("scanner:"))
    return f.groupBy(F.col("pr").alias("report_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"])).alias("list"))


@query(
    f"""{F0} SELECT pr AS report_id, 'gitleaks' AS tool, category AS rule_id, path, start_line AS line, 'secret' AS kind, 'HIGH' AS severity,
CASE WHEN ord % 10 = 0 THEN 'gitleaks rule "'||category||'" matched' ELSE content END AS description, 'key = ***REDACTED***;' AS evidence FROM fx_findings WHERE source LIKE 'scanner:%'"""
)
def gitleaks_reports(spark: SparkSession, d: str) -> DataFrame:
    """SRC-6, FUN-3."""
    secret = F.concat(F.lit("s"), F.col("ord").cast("string"))
    entry = F.struct(
        F.col("category").alias("RuleID"), F.when(F.col("ord") % 10 == 0, "").otherwise(F.col("content")).alias("Description"),
        F.concat(F.when(F.col("ord") % 3 == 0, "/repo/").when(F.col("ord") % 3 == 1, "./").otherwise(""), "path").alias("File"),
        F.col("start_line").alias("StartLine"), F.concat(F.lit("key = "), secret, F.lit(";")).alias("Match"), secret.alias("Secret"),
    )
    return reports.gitleaks_findings(_reports(spark, d, entry).select("report_id", F.lit("/repo").alias("root"), F.col("list").alias("body")))


@query(
    f"""{F0} SELECT pr AS report_id, 'semgrep' AS tool, category AS rule_id, path, start_line AS line, 'sast' AS kind,
CASE severity WHEN 'critical' THEN 'HIGH' WHEN 'info' THEN 'INFO' ELSE 'MEDIUM' END AS severity, CASE WHEN ord % 10 = 0 THEN category ELSE content END AS description, 'x = 1' AS evidence
FROM fx_findings WHERE source LIKE 'scanner:%'"""
)
def semgrep_reports(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7."""
    sev = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "info", " Info ").when(F.col("severity") == "low", "WARNING").otherwise("odd")
    entry = F.struct(
        F.col("category").alias("check_id"), "path", F.struct(F.col("start_line").alias("line")).alias("start"),
        F.struct(F.when(F.col("ord") % 10 == 0, "").otherwise(F.col("content")).alias("message"), sev.alias("severity"), F.lit("  x = 1\n").alias("lines")).alias("extra"),
    )
    return reports.semgrep_findings(_reports(spark, d, entry).select("report_id", F.concat(F.lit('{"results": '), "list", F.lit("}")).alias("body")))


@query(
    f"""{F0}, s AS (SELECT * FROM fx_findings WHERE source LIKE 'scanner:%' AND ord % 4 <> 0),
about AS (SELECT pr, category, arg_max(content, ord) AS summary FROM s WHERE ord % 3 = 0 GROUP BY ALL)
SELECT DISTINCT s.pr AS report_id, 'govulncheck' AS tool, s.category AS rule_id, path, start_line AS line, 'cve' AS kind, 'HIGH' AS severity, coalesce(summary, s.category) AS description, 'p.F' AS evidence
FROM s LEFT JOIN about a ON a.pr = s.pr AND a.category = s.category"""
)
def govulncheck_reports(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8: streams of pretty-printed messages; a fourth of the findings stay outside the user's code."""
    f = fx.findings(spark, d).where(F.col("source").startswith("scanner:"))
    mine = F.col("ord") % 4 != 0
    osv = F.when(mine & (F.col("ord") % 3 == 0), F.to_json(F.struct(F.struct(F.col("category").alias("id"), F.col("content").alias("summary")).alias("osv")), {"pretty": "true"}))
    step = lambda m, file, line: F.struct(F.lit(m).alias("module"), F.lit("p").alias("package"), F.lit("F").alias("function"), F.struct(file.alias("filename"), line.alias("line")).alias("position"))
    trace = F.array(step("std", F.lit("/go/src/x.go"), F.lit(1)), F.when(mine, step("own", F.concat(F.lit("/repo/"), "path"), F.col("start_line"))).otherwise(step("dep", F.lit("y.go"), F.lit(2))))
    found = F.to_json(F.struct(F.struct(F.col("category").alias("osv"), trace.alias("trace")).alias("finding")), {"pretty": "true"})
    both = f.select("pr", "ord", F.concat_ws("\n", osv, found).alias("m"))
    body = both.groupBy(F.col("pr").alias("report_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "m"))), lambda x: x["m"]), "\n").alias("body"))
    roots = body.select("report_id", F.lit("/repo").alias("root"), F.lit("own").alias("module"))
    return reports.govulncheck_findings(reports.json_messages(body), roots)


# --- SARIF and documents -------------------------------------------------------------------------


def _sarif_rows(spark: SparkSession, d: str) -> DataFrame:
    f = scoring.score(findings.with_fingerprint(fx.findings(spark, d)))
    return f.select(
        F.col("pr").alias("run"), "ord", "source", F.col("category").alias("rule_id"), "path", "start_line", (F.col("end_line") + F.col("ord") % 2).cast("int").alias("end_line"),
        F.col("score_severity").alias("severity"), F.col("content").alias("description"), "fingerprint",
    )


_LEVEL = "CASE WHEN score_severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN score_severity = 'LOW' THEN 'note' ELSE 'warning' END"


@query(
    f"""{FS} SELECT pr AS run, CAST(row_number() OVER (PARTITION BY pr ORDER BY ord) - 1 AS INT) AS nth, source||'/'||category AS rule_id, {_LEVEL} AS level, path AS uri,
CASE WHEN start_line > 0 THEN start_line ELSE 0 END AS start_line, CASE WHEN start_line > 0 AND ord % 2 = 1 THEN end_line + 1 ELSE 0 END AS end_line, {FP_SQL} AS fingerprint
FROM fx_scored WHERE score_severity <> 'SUPPRESS'"""
)
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1: the results of the encoded documents, read back."""
    kind = "struct<runs: array<struct<results: array<struct<ruleId: string, level: string, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>>>, fingerprints: map<string, string>>>>>>"
    j = sarif.encode(_sarif_rows(spark, d)).select("run", F.posexplode(F.from_json("sarif", kind)["runs"][0]["results"]).alias("nth", "r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return j.select(
        "run", "nth", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), place["artifactLocation"]["uri"].alias("uri"), F.coalesce(place["region"]["startLine"], F.lit(0)).alias("start_line"),
        F.coalesce(place["region"]["endLine"], F.lit(0)).alias("end_line"), F.col("r.fingerprints")["primary"].alias("fingerprint"),
    )


@query(
    f"""{FS} SELECT pr AS run, source||'/'||category AS id, arg_min(category, ord) AS name, arg_min(content, ord) AS description, arg_min(score_severity, ord) AS severity FROM fx_scored GROUP BY ALL"""
)
def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17."""
    return sarif.rule_catalogue(_sarif_rows(spark, d)).select("run", "id", F.col("f.rule_id").alias("name"), F.col("f.description").alias("description"), F.col("f.severity").alias("severity"))


@query(
    f"""{F0}, p AS (SELECT DISTINCT pr FROM fx_findings) SELECT pr AS run, CASE pr % 7 WHEN 1 THEN 'version' WHEN 2 THEN 'no runs' WHEN 3 THEN 'null results' WHEN 4 THEN 'ruleId'
  WHEN 5 THEN 'level' ELSE 'startLine' END AS violation FROM p WHERE pr % 7 <> 0"""
)
def sarif_violations(spark: SparkSession, d: str) -> DataFrame:
    """SNK-3: one kind of fault in six documents of seven."""
    good = '{"version": "2.1.0", "runs": [{"results": [{"ruleId": "a", "level": "note", "locations": [{"physicalLocation": {"region": {"startLine": 1}}}]}]}]}'
    bad = [
        good, good.replace("2.1.0", "2.0"), '{"version": "2.1.0", "runs": []}', '{"version": "2.1.0", "runs": [{"results": null}]}', good.replace('"a"', '""'), good.replace("note", "odd"), good.replace(": 1}", ": 0}"),
    ]
    docs = fx.findings(spark, d).select(F.col("pr").alias("run")).distinct()
    return sarif.violations(docs.withColumn("sarif", F.element_at(F.array(*[F.lit(b) for b in bad]), (F.col("run") % 7 + 1).cast("int"))))


@query(
    f"""{FS} SELECT pr AS session_id, CAST(count(*) AS BIGINT) AS n_comments, count(*) FILTER (score_severity <> 'SUPPRESS') AS n_scored, pr % 3 = 0 AS has_summary,
string_agg(path, ',' ORDER BY ord) AS paths FROM fx_scored GROUP BY ALL"""
)
def session_documents(spark: SparkSession, d: str) -> DataFrame:
    """SNK-2: session documents, read back."""
    f = scoring.score(fx.findings(spark, d))
    sev = F.when(F.col("score_severity") == "SUPPRESS", "").otherwise(F.col("score_severity"))
    comments = f.select(F.col("pr").alias("session_id"), "ord", "path", "content", sev.alias("severity"))
    note = F.struct(F.when(F.col("session_id") % 3 == 0, "s").otherwise("").alias("title"))
    docs = store.envelopes(comments.select("session_id").distinct().withColumn("summary", note), comments)
    j = docs.select("session_id", F.from_json("document", "struct<comments: array<struct<path: string, severity: string>>, summary: struct<title: string>>").alias("j"))
    return j.select(
        "session_id", F.size("j.comments").cast("long").alias("n_comments"), F.size(F.filter("j.comments", lambda c: c["severity"].isNotNull())).cast("long").alias("n_scored"),
        F.col("j.summary").isNotNull().alias("has_summary"), F.array_join(F.transform("j.comments", lambda c: c["path"]), ",").alias("paths"),
    )


@query(
    f"""{F0} SELECT owner, repo, pr, ord, path FROM fx_findings WHERE run_id = 1 AND pr % 3 <> 1 AND pr % 3 <> 2
UNION ALL SELECT owner, repo, pr, ord, path FROM fx_findings WHERE run_id = 2 AND pr % 3 = 1"""
)
def stored_findings(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4: run 1 of all change sets is stored, then run 2 of a third, and nothing for another third."""
    path = shared.new_folder(spark, "findings")
    f = fx.findings(spark, d).select(*KEY, "run_id", "ord", "path")
    one, two = (f.where(F.col("run_id") == k).drop("run_id") for k in (1, 2))
    store.write_findings(one, f.select(*KEY), path)
    store.write_findings(two.where("pr % 3 = 1"), f.where("pr % 3 > 0").select(*KEY), path)
    return store.read_findings(spark, path, one.schema)


_STATE = """last AS (SELECT owner, repo, pr, max(push) AS last_push, arg_max(seen, (push, seen)) AS now FROM fx_pushes GROUP BY ALL),
once AS (SELECT owner, repo, pr, fingerprint, path, push, arg_max(seen, ord) AS seen FROM fx_pushes WHERE fingerprint IS NOT NULL GROUP BY ALL),
touch AS (SELECT DISTINCT owner, repo, pr, path, push FROM fx_pushes),
m AS (SELECT o.*, lead(push) OVER (PARTITION BY owner, repo, pr, fingerprint ORDER BY push) AS nxt,
  (SELECT min(t.push) FROM touch t WHERE t.owner = o.owner AND t.repo = o.repo AND t.pr = o.pr AND t.path = o.path AND t.push > o.push) AS again FROM once o),
ends AS (SELECT *, CASE WHEN nxt IS NULL THEN again IS NOT NULL ELSE coalesce(again < nxt, false) END AS ends FROM m),
l AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY owner, repo, pr, fingerprint ORDER BY push ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM ends),
b AS (SELECT *, first(seen) OVER w AS first_seen, row_number() OVER w AS nth FROM l WINDOW w AS (PARTITION BY owner, repo, pr, fingerprint, life ORDER BY push))
SELECT owner, repo, pr, fingerprint, p.path, p.ord, CASE WHEN p.push < last_push THEN 'carried' WHEN nth > 1 THEN 'keep' ELSE 'new' END AS state, first_seen,
  CASE WHEN p.push < last_push THEN now ELSE p.seen END AS last_seen
FROM b JOIN fx_pushes p USING (owner, repo, pr, fingerprint, push) JOIN last USING (owner, repo, pr) WHERE nxt IS NULL AND NOT ends"""


@query(f"{F0}, {fx.PUSHES_SQL}, {_STATE}")
def pushed_findings(spark: SparkSession, d: str) -> DataFrame:
    """STR-1: a stream over the events folds all pushes of each change set, in order, into a store; this is its state."""
    events = fx.table(spark, d, "events")
    arriving = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    state, checkpoint = shared.new_folder(spark, "pushed"), shared.new_folder(spark, "pushed-checkpoint")
    continuous.reconcile_stream(fx.pushes_of(fx.findings_of(arriving)), state, checkpoint, available_now=True).awaitTermination()
    return continuous.current_state(spark, state).drop("push", "batch")


@query(
    f"""{F0}, f AS (SELECT DISTINCT repo, path, pr % 3 AS k FROM fx_findings), files AS (SELECT repo, path, min(k) AS k FROM f GROUP BY ALL)
SELECT repo, path, 's'||n AS name, CASE k WHEN 1 THEN 'second' ELSE 'first' END AS written FROM files, range(3) t(n) WHERE k <> 2 AND (k <> 1 OR n > 0)"""
)
def committed_index(spark: SparkSession, d: str) -> DataFrame:
    """JON-5, JON-6: files and their symbols in one store; a third is read again with fewer symbols, a third vanishes."""
    files = fx.findings(spark, d).groupBy("repo", "path").agg(F.min(F.col("pr") % 3).alias("k"))
    names = F.explode(F.array(*[F.lit(f"s{n}") for n in range(3)])).alias("name")
    symbols = lambda written: files.select("repo", "path", "k", names).withColumn("written", F.lit(written))
    kept = index.stored_index(spark, shared.new_folder(spark, "index"), {"files": "repo string, path string, k long", "symbols": "repo string, path string, name string, written string"})
    kept.replace({"files": files, "symbols": symbols("first")}, files)
    kept.replace({"files": files.where("k = 1"), "symbols": symbols("second").where("k = 1 and name <> 's0'")}, files.where("k = 1"))
    kept.replace({}, files.where("k = 2"))
    return kept.read("symbols")


# --- the rest ------------------------------------------------------------------------------------


@query(f"{PAIRS} SELECT repo, a, b FROM pairs WHERE b % 4 <> 0 AND b % 5 <> 1 AND a % 9 <> (b + 1) % 9 AND b % 9 <> (a + 1) % 9")
def gated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14: overlap candidates without drafts, bots and stacked neighbours."""
    ref = lambda c: F.concat(F.lit("h"), (c % 9).cast("string"))
    pairs = overlap.overlap_pairs(fx.pull_requests(spark, d)).select("repo", "a", "b")
    for k in ("a", "b"):
        pairs = pairs.withColumn(f"{k}_head_ref", ref(F.col(k))).withColumn(f"{k}_base_ref", ref(F.col(k) + 1))
    pairs = pairs.withColumn("b_is_draft", F.col("b") % 4 == 0).withColumn("b_user_login", F.when(F.col("b") % 5 == 1, "x[bot]").otherwise("x"))
    return overlap.gate(pairs).select("repo", "a", "b")


@query(
    f"""WITH {fx.PRS_SQL}, p AS (SELECT number, list_sort(paths) AS x FROM fx_prs)
SELECT number, array_to_string(x[1:3], ', ')||CASE WHEN len(x) > 3 THEN ' +'||(len(x) - 3)||' more' ELSE '' END AS shared_text FROM p"""
)
def shared_paths_text(spark: SparkSession, d: str) -> DataFrame:
    """TOP-6."""
    p = fx.pull_requests(spark, d).select("number", F.array_sort("paths").alias("shared_paths"))
    return overlap.shared_display(p).select("number", "shared_text")


_ITEM = "SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, 'f'||(l_orderkey % 40) AS file, 'n'||(l_partkey % 5) AS name, 'r'||(l_suppkey % 2) AS repo FROM lineitem"
_MINE = "((repo = 'r0' AND o % 40 >= 20) OR (repo = 'r1' AND o % 40 >= 24 AND o % 40 < 35))"


@query(
    f"""WITH i AS ({_ITEM}), old AS (SELECT DISTINCT repo, name, file AS file_path, 'old' AS version, o % 40 AS no FROM i WHERE o % 40 < 30), new AS (SELECT * FROM i WHERE {_MINE})
SELECT repo, name, file_path, version FROM old WHERE (repo, file_path) NOT IN (SELECT (repo, file) FROM new) AND (no >= 20 OR (no + CASE repo WHEN 'r0' THEN 0 ELSE 1 END) % 3 <> 0)
UNION ALL SELECT repo, name, file, arg_max(o||'.'||n||'.'||pk||'.'||sk, (o, n, pk, sk)) FROM new GROUP BY repo, name, file"""
)
def replaced_packages(spark: SparkSession, d: str) -> DataFrame:
    """JON-7: packages of re-read files are replaced, those of vanished files go; both repositories have the same paths."""
    s = lambda c: F.col(c).cast("string")
    i = fx.table(spark, d, "lineitem").select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 2).cast("string")).alias("repo"),
        F.concat(F.lit("n"), (F.col("l_partkey") % 5).cast("string")).alias("name"), F.lit("npm").alias("kind"),
        F.concat_ws(".", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("version"), F.concat(F.lit("f"), (F.col("l_orderkey") % 40).cast("string")).alias("file_path"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"), (F.col("l_orderkey") % 40).alias("no"),
    )
    last = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in i.schema["ord"].dataType.fields])
    old = i.where("no < 30").select("repo", "name", "kind", F.lit("old").alias("version"), "file_path").distinct().withColumn("ord", last)
    live = i.where("no >= 20 or (no + if(repo = 'r0', 0, 1)) % 3 <> 0").select("repo", "file_path")
    new = i.where("(repo = 'r0' and no >= 20) or (repo = 'r1' and no >= 24 and no < 35)").drop("no")
    return index.replace_packages(old, new, live).select("repo", "name", "file_path", "version")


@query(
    f"""WITH i AS ({_ITEM}), old AS (SELECT DISTINCT file AS path, name, 'class' AS kind FROM i WHERE o % 40 < 30), new AS (SELECT * FROM i WHERE o % 40 >= 20)
SELECT * FROM old WHERE CAST(substr(path, 2) AS INT) < 20
UNION ALL SELECT file, name, arg_min(CASE WHEN n % 2 = 0 THEN 'function' ELSE 'method' END, (o, n, pk, sk)) FROM new WHERE name <> 'n0' GROUP BY file, name"""
)
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    """JON-6: symbols of re-read files are replaced; blank names go, a missing kind is a function."""
    name = F.concat(F.lit("n"), (F.col("l_partkey") % 5).cast("string"))
    i = fx.table(spark, d, "lineitem").select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("l_orderkey") % 40).cast("string")).alias("path"), F.when(name == "n0", "  ").otherwise(name).alias("name"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("method").alias("kind"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        (F.col("l_orderkey") % 40).alias("no"), name.alias("full"),
    )
    none = F.lit(None).cast(i.schema["ord"].dataType)
    old = i.where("no < 30").select("repo", "path", F.col("full").alias("name"), F.lit("class").alias("kind")).distinct().withColumn("ord", none)
    return index.replace_children(old, i.where("no >= 20").drop("no", "full")).select("path", "name", "kind")


@query(
    """SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE regexp_replace(b||CASE WHEN strlen(b) < 200 THEN chr(65533) ELSE '' END, '\\n[^\\n]*$', '')||chr(10)||'... (truncated)' END AS excerpt,
CASE WHEN length(f) > 120 THEN left(f, 120)||'…' ELSE f END AS one_line FROM (SELECT doc_id, text, left(text, list_max(list_filter(range(201), lambda i: strlen(left(text, i)) <= 200))) AS b, replace(trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '|', '\\|') AS f FROM documents WHERE lang = 'en')"""
)
def text_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """FUN-10, FUN-14 on the English texts: an excerpt has 200 bytes, and a character that they cut becomes U+FFFD."""
    docs = fx.table(spark, d, "documents").where("lang = 'en'")
    return docs.select("doc_id", T.excerpt(F.col("text"), 200).alias("excerpt"), T.one_line(F.col("text")).alias("one_line"))


@query(
    """SELECT doc_id, '# A'||chr(10)||left(text, 1)||CASE WHEN doc_id % 2 = 0 THEN chr(10)||'## Notes' ELSE '' END||chr(10)||'# End' AS text FROM documents WHERE text <> '' AND left(text, 1) NOT IN ('#', chr(10))"""
)
def kept_sections(spark: SparkSession, d: str) -> DataFrame:
    """FUN-12: a section 'Drop' with all below it goes."""
    head = F.substring("text", 1, 1)
    tail = F.when(F.col("doc_id") % 2 == 0, "\n## Notes").otherwise("")
    doc = F.concat(F.lit("# A\n"), head, F.lit("\n## drop  \nx\n### deep\ny"), tail, F.lit("\n# End"))
    docs = fx.table(spark, d, "documents").where("text <> '' and substring(text, 1, 1) not in ('#', '\\n')")
    return docs.select("doc_id", T.without_sections(doc, ("drop",)).alias("text"))
