"""Queries over derived findings and changes, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.filetype import INDEXABLE, language, sql_language
from tidemark.functions.text import churn, finding_key
from tidemark.operators import effort, findings, scoring, selection
from tidemark.operators.scoring import DEFAULTS, KEY, POLICY
from tidemark.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared SQL ----------------------------------------------------------------------------------

_ENTRIES = {**POLICY, "defaults": DEFAULTS}
_POLICY_SQL = (
    "policy AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {i:.2f}::DOUBLE, {c:.2f}::DOUBLE)" for k, (i, c, _) in _ENTRIES.items())
    + ") t(key, impact, floor)), sevmap AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}','{s}','{v}')" for k, (_, _, m) in _ENTRIES.items() for s, v in m.items())
    + ") t(key, raw, sev))"
)
SCORED_SQL = f"""{_POLICY_SQL},
keyed AS (SELECT f.*, coalesce((SELECT key FROM policy p WHERE p.key = f.category), (SELECT key FROM policy p WHERE p.key = split_part(f.category,'.',1)), 'defaults') AS rationale FROM fx_findings f),
fx_scored AS (SELECT k.*, coalesce(a.sev, d.sev, 'SUPPRESS') AS score_severity,
  least(p.floor + CASE WHEN k.source LIKE 'scanner:%' OR contains(k.category,'.') THEN 0.05::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS confidence, p.impact
  FROM keyed k JOIN policy p ON p.key = k.rationale LEFT JOIN sevmap a ON a.key = k.rationale AND a.raw = k.severity
  LEFT JOIN sevmap d ON d.key = k.rationale AND d.raw = 'default')"""
F0 = f"WITH {fx.FINDINGS_SQL}"
FS = f"{F0}, {SCORED_SQL}"
_RANK = "CASE score_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
FP_SQL = """sha256(concat_ws('|', owner, repo, category, regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || lower(regexp_extract(path, '(\\.[^./]*)$', 1)),
  CASE WHEN start_line = 0 AND end_line = 0 THEN '' ELSE 'L'||start_line||'-'||end_line END, ''))"""
FC = f"{F0}, {fx.CHANGES_SQL}"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(fx.findings(spark, d))


@query(
    f"""{FS}, kept AS (SELECT * FROM fx_scored WHERE score_severity <> 'SUPPRESS' AND {_RANK} >= 1),
firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY owner, repo, pr, path, start_line, end_line, source LIKE 'scanner:%' ORDER BY ord) = 1)
SELECT owner, repo, pr, count(*) FILTER (score_severity='CRITICAL') AS n_critical, count(*) FILTER (score_severity='HIGH') AS n_high,
  count(*) FILTER (score_severity='MEDIUM') AS n_medium, count(*) FILTER (score_severity='LOW') AS n_low FROM firsts GROUP BY owner, repo, pr"""
)
def findings_severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """JON-8, FLT-8, WIN-1, AGG-3: what survives policy, by change set."""
    return scoring.severity_histogram(scoring.first_by_location(scoring.at_least(_scored(spark, d))))


@query(
    f"""{FS}, kept AS (SELECT * FROM fx_scored WHERE score_severity <> 'SUPPRESS'), k AS (SELECT owner, repo, pr, path, start_line, end_line, left(content, 64), arg_max(score_severity, ord) AS s FROM kept GROUP BY ALL)
SELECT owner, repo, pr, count(*) FILTER (s='CRITICAL') AS n_critical, count(*) FILTER (s='HIGH') AS n_high, count(*) FILTER (s='MEDIUM') AS n_medium, count(*) FILTER (s='LOW') AS n_low FROM k GROUP BY owner, repo, pr"""
)
def effort_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5: what effort counts of the findings that survive policy, one for each key."""
    return effort.effort_severities(_scored(spark, d).where("score_severity <> 'SUPPRESS'"))


@query(f"{F0} SELECT * FROM fx_findings")
def fx_findings(spark: SparkSession, d: str) -> DataFrame:
    return fx.findings(spark, d)


@query(f"{FC} SELECT * EXCLUDE (diff), length(diff) AS n_diff FROM fx_changes")
def fx_changes(spark: SparkSession, d: str) -> DataFrame:
    return fx.changes(fx.findings(spark, d)).withColumn("n_diff", F.length("diff").cast("long")).drop("diff")


@query(f"{FS} SELECT ord, score_severity, round(confidence, 6) AS confidence, impact, rationale FROM fx_scored")
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("ord", "score_severity", F.round("confidence", 6).alias("confidence"), "impact", "rationale")


@query(f"{FS} SELECT ord, score_severity FROM fx_scored WHERE score_severity <> 'SUPPRESS' AND {_RANK} >= 3")
def severity_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scoring.at_least(_scored(spark, d), "HIGH").select("ord", "score_severity")


@query(f"{F0} SELECT ord, path FROM fx_findings WHERE NOT (start_line = 0 AND end_line = 0)")
def located_findings(spark: SparkSession, d: str) -> DataFrame:
    return scoring.located(fx.findings(spark, d)).select("ord", "path")


@query(
    f"""{F0} SELECT ord, CASE WHEN category IN ('bug','security','performance','maintainability','test','style','documentation','other') THEN category ELSE 'other' END AS category,
CASE WHEN severity IN ('critical','high','medium','low') THEN severity ELSE 'low' END AS severity FROM fx_findings"""
)
def normalized_findings(spark: SparkSession, d: str) -> DataFrame:
    return scoring.normalized(fx.findings(spark, d)).select("ord", "category", "severity")


_SUGGESTED = "CASE WHEN ord%3=0 THEN 'fix()' ELSE '' END"


def _suggested(spark: SparkSession, d: str) -> DataFrame:
    return fx.findings(spark, d).withColumn("suggestion_code", F.when(F.col("ord") % 3 == 0, "fix()").otherwise(""))


@query(
    f"""{F0} SELECT ord, severity='low' AND category IN ('style','maintainability','test','documentation') AND {_SUGGESTED} <> '' AS is_suggestion,
severity='low' AND category IN ('style','maintainability','test','documentation') AS is_nit FROM fx_findings"""
)
def suggestion_flags(spark: SparkSession, d: str) -> DataFrame:
    return _suggested(spark, d).select("ord", scoring.is_suggestion().alias("is_suggestion"), scoring.is_nit().alias("is_nit"))


@query(f"{F0} SELECT ord FROM fx_findings QUALIFY row_number() OVER (PARTITION BY owner, repo, pr, path, start_line, end_line, source LIKE 'scanner:%' ORDER BY ord) = 1")
def first_by_location(spark: SparkSession, d: str) -> DataFrame:
    return scoring.first_by_location(fx.findings(spark, d)).select("ord")


@query(
    f"""{FS}, t AS (SELECT owner, repo, pr, max(greatest(CASE score_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 ELSE 0 END,
  CASE WHEN NOT source LIKE 'scanner:%' THEN 0 WHEN severity='critical' THEN 4 WHEN severity='high' THEN 3 ELSE 0 END)) AS target FROM fx_scored GROUP BY ALL),
l AS (SELECT DISTINCT owner, repo, pr, CASE WHEN pr%3=0 THEN 'risk/critical' WHEN pr%3=1 THEN 'risk/low' ELSE '' END AS risk_tag FROM fx_findings)
SELECT l.owner, l.repo, l.pr, CASE WHEN coalesce(t.target,0) > CASE risk_tag WHEN 'risk/critical' THEN 4 WHEN 'risk/low' THEN 1 ELSE 0 END
  THEN CASE t.target WHEN 4 THEN 'risk/critical' ELSE 'risk/high' END ELSE risk_tag END AS risk_tag FROM l LEFT JOIN t USING (owner, repo, pr)"""
)
def escalated_risk(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    tag = F.when(F.col("pr") % 3 == 0, "risk/critical").when(F.col("pr") % 3 == 1, "risk/low").otherwise("")
    return scoring.risk_label(scored, scored.select(*KEY, tag.alias("risk_tag")).distinct())


@query(
    f"""{FS}, g AS (SELECT * FROM fx_scored WHERE (pr % 3 <> 0 OR score_severity <> 'CRITICAL') AND (pr % 6 <> 1 OR severity <> 'critical'))
SELECT owner, repo, pr, CASE WHEN bool_or(NOT (severity='low' AND category IN ('style','maintainability','test','documentation') AND {_SUGGESTED} <> '')
  AND CASE WHEN pr % 3 = 1 THEN severity = 'critical' ELSE score_severity='CRITICAL' END) THEN 3 ELSE 0 END AS exit_code FROM g GROUP BY ALL"""
)
def blocker_gate(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: a third of the change sets has no critical finding, a third is unscored, so raw labels decide, of which half have none."""
    g = scoring.score(_suggested(spark, d)).where("(pr % 3 <> 0 or score_severity <> 'CRITICAL') and (pr % 6 <> 1 or severity <> 'critical')")
    return scoring.blocker_gate(g.withColumn("score_severity", F.when(F.col("pr") % 3 != 1, F.col("score_severity"))))


@query(
    f"""{F0} SELECT ord, CASE WHEN severity='low' AND category='style' THEN '**[nit]** ' ELSE '' END || '**['||severity||' / '||category||']** ' || content ||
  CASE WHEN ord%6=0 THEN chr(10)||chr(10)||'```suggestion'||chr(10)||'fix()'||chr(10)||'```' ELSE '' END || chr(10)||chr(10)||'<!-- review:fp:' || {FP_SQL} || ' -->' AS body FROM fx_findings"""
)
def comment_bodies(spark: SparkSession, d: str) -> DataFrame:
    f = findings.with_fingerprint(_suggested(spark, d)).withColumn("existing_code", F.when(F.col("ord") % 2 == 0, "old()").otherwise(""))
    return f.select("ord", scoring.comment_body(F.col("fingerprint")).alias("body"))


@query(f"{F0} SELECT ord, {FP_SQL} AS fingerprint FROM fx_findings")
def recovered_markers(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: fingerprints read back from posted comments."""
    return comment_bodies(spark, d).select("ord", scoring.marked_fingerprint(F.col("body")).alias("fingerprint")).where("fingerprint <> ''")


@query(f"{F0} SELECT ord, {FP_SQL} AS fingerprint FROM fx_findings")
def finding_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return findings.with_fingerprint(fx.findings(spark, d)).select("ord", "fingerprint")


@query(
    f"""{F0}, s AS (SELECT * EXCLUDE (owner), 'acme' AS owner, CASE ord % 4 WHEN 0 THEN 'call('||k||') "a//b" https://x.y' WHEN 1 THEN 'call('||k||')' WHEN 2 THEN 'x = ''#'' + `//`' ELSE '' END AS snippet
  FROM (SELECT *, start_line AS k FROM fx_findings))
SELECT ord, sha256(concat_ws('|', owner, repo, category, regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || lower(regexp_extract(path, '(\\.[^./]*)$', 1)), 'sym', snippet)) AS fingerprint FROM s"""
)
def snippet_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """FUN-1 with quoted code: line numbers, comments and white space don't count, strings and URLs do."""
    k = F.col("start_line").cast("string")
    forms = [
        F.concat(F.lit("  12: call("), k, F.lit(')  "a//b"\n 13 | https://x.y # note '), F.col("ord").cast("string")), F.concat(F.lit("call("), k, F.lit(")\t// "), F.col("ord").cast("string")),
        F.lit("x  =  '#' + `//`   // tail"), F.lit("// only a comment\n# and one more"),
    ]
    code = F.element_at(F.array(*forms), (F.col("ord") % 4 + 1).cast("int"))
    f = fx.findings(spark, d).withColumn("existing_code", code).withColumn("symbol", F.lit(" sym "))
    return findings.with_fingerprint(f).select("ord", "fingerprint")


@query(f"{F0} SELECT ord, path||':'||start_line||'-'||end_line||':'||left(content,64) AS finding_key FROM fx_findings")
def finding_keys(spark: SparkSession, d: str) -> DataFrame:
    return fx.findings(spark, d).select("ord", finding_key(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("finding_key"))


_STATES = f"""{F0}, {fx.CHANGED_SQL}, p AS (SELECT *, {FP_SQL} AS fingerprint FROM fx_findings),
one AS (SELECT owner, repo, pr, run_id, fingerprint, max(path) AS path, max(ord) AS ord FROM p GROUP BY ALL),
prev AS (SELECT * FROM one WHERE run_id = 1), fresh AS (SELECT * FROM one WHERE run_id = 2),
states AS (
  SELECT f.owner, f.repo, f.pr, f.fingerprint, f.path, f.ord, CASE WHEN p.ord IS NULL THEN 'new' ELSE 'keep' END AS state, coalesce(p.ord, f.ord) AS first_seen, f.ord AS last_seen
  FROM fresh f LEFT JOIN prev p USING (owner, repo, pr, fingerprint)
  UNION ALL
  SELECT p.owner, p.repo, p.pr, p.fingerprint, p.path, p.ord, CASE WHEN c.path IS NULL THEN 'carried' ELSE 'resolved' END, p.ord,
    CASE WHEN c.path IS NULL THEN coalesce(n.now, p.ord) ELSE p.ord END
  FROM prev p ANTI JOIN fresh f USING (owner, repo, pr, fingerprint) LEFT JOIN fx_changed c USING (owner, repo, pr, path)
  LEFT JOIN (SELECT owner, repo, pr, max(ord) AS now FROM fresh GROUP BY ALL) n USING (owner, repo, pr))"""


def _states(spark: SparkSession, d: str, resolved: bool) -> DataFrame:
    f = fx.findings(spark, d)
    return findings.reconcile_runs(findings.with_fingerprint(f), 1, 2, fx.changed_paths(f), resolved)


@query(f"{_STATES} SELECT * FROM states WHERE state <> 'resolved'")
def reconciled_findings(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d, False)


@query(
    f"""{_STATES} SELECT owner, repo, pr, count(*) FILTER (state='keep') AS n_kept, count(*) FILTER (state='new') AS n_new,
count(*) FILTER (state='carried') AS n_carried, count(*) FILTER (state='resolved') AS n_resolved FROM states GROUP BY ALL"""
)
def carryover_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.carryover_counts(_states(spark, d, True))


@query(
    f"""{F0}, {fx.CHANGED_SQL} SELECT f.ord FROM fx_findings f SEMI JOIN fx_changed c USING (owner, repo, pr, path)
WHERE f.source LIKE 'scanner:%' AND NOT regexp_matches(lower(f.path), '(^|/)(\\.claude|vendor|node_modules)/')"""
)
def scoped_scanner_findings(spark: SparkSession, d: str) -> DataFrame:
    f = fx.findings(spark, d)
    return findings.in_changed_paths(f.where(F.col("source").startswith("scanner:")), fx.changed_paths(f)).select("ord")


@query(
    f"""{F0} SELECT owner, repo, pr, ord, path, CASE WHEN source LIKE 'scanner:%' THEN 'security' ELSE category END AS category, severity, source,
CASE WHEN source LIKE 'scanner:%' THEN greatest(start_line, 1) ELSE start_line END AS start_line, CASE WHEN source LIKE 'scanner:%' THEN greatest(start_line, 1) ELSE end_line END AS end_line,
CASE WHEN NOT source LIKE 'scanner:%' THEN content WHEN ord%10=0 THEN 'gitleaks finding' ELSE content END || CASE WHEN source LIKE 'scanner:%' THEN chr(10)||chr(10)||'***' ELSE '' END AS content FROM fx_findings"""
)
def unified_findings(spark: SparkSession, d: str) -> DataFrame:
    f = fx.findings(spark, d)
    scan = F.col("source").startswith("scanner:")
    s = f.where(scan).select(
        *KEY, "ord", F.substring("source", 9, 100).alias("tool"), "path", F.col("start_line").alias("line"), F.upper("severity").alias("severity"),
        F.when(F.col("ord") % 10 == 0, "").otherwise(F.col("content")).alias("description"), F.lit("***").alias("evidence"),
    )
    return findings.unified(f.where(~scan), s)


@query(f"{F0} SELECT owner, repo, pr, path, count(*) AS n, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS ords FROM fx_findings GROUP BY ALL")
def findings_by_path(spark: SparkSession, d: str) -> DataFrame:
    g = scoring.grouped_by_path(fx.findings(spark, d))
    return g.select(*KEY, "path", "n", F.array_join(F.transform("findings", lambda x: x["ord"].cast("string")), ",").alias("ords"))


@query(
    f"""{F0} SELECT owner, repo, pr, count(*) FILTER (source='scanner:gitleaks') AS n_gitleaks, count(*) FILTER (source='scanner:semgrep') AS n_semgrep,
count(*) FILTER (source='scanner:govulncheck') AS n_govulncheck FROM fx_findings GROUP BY ALL"""
)
def scanner_tally(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scanner_tally(fx.findings(spark, d))


@query(f"{F0}, n AS (SELECT *, row_number() OVER (PARTITION BY owner, repo, pr, path ORDER BY ord) - 1 AS n FROM fx_findings) SELECT ord FROM n WHERE n <> pr % 4")
def removed_nth_findings(spark: SparkSession, d: str) -> DataFrame:
    f = fx.findings(spark, d)
    gone = f.select(*KEY, "path", (F.col("pr") % 4).cast("int").alias("n")).distinct()
    return scoring.drop_nth(f, gone).select("ord")


@query(f"{F0} SELECT ord, row_number() OVER (PARTITION BY owner, repo, pr ORDER BY source, path, start_line, category, ord) AS rank FROM fx_findings WHERE source LIKE 'scanner:%'")
def scanner_order(spark: SparkSession, d: str) -> DataFrame:
    """TOP-3."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("source", "path", "start_line", "category", "ord")
    return fx.findings(spark, d).where(F.col("source").startswith("scanner:")).select("ord", F.row_number().over(w).cast("long").alias("rank"))


# --- changes -------------------------------------------------------------------------------------

_LANG = sql_language("new_path")
_INDEXED = f"({_LANG}) IN ({', '.join(repr(x) for x in INDEXABLE)})"
_DEFAULT_SKIP = r"regexp_matches(new_path, '(^|/)(vendor|node_modules|dist|build|\.git|__pycache__)/') OR regexp_matches(new_path, '(\.lock|\.min\.js|\.min\.css|\.map)$|(^|/)(package-lock\.json|yarn\.lock)$')"
_REASON = f"""CASE WHEN is_binary THEN 'binary' WHEN is_deleted THEN 'deleted' WHEN NOT {_INDEXED} THEN 'extension' WHEN {_DEFAULT_SKIP} THEN 'default_pattern'
  WHEN (strlen(diff)+3)//4 > 2500 THEN 'too_large' ELSE '' END"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_changes(fx.changes(fx.findings(spark, d)), max_tokens=2500)


@query(f"{FC} SELECT owner, repo, pr, new_path, {_REASON} AS reason, ({_REASON}) = '' AS included FROM fx_changes")
def selection_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d).select(*KEY, "new_path", "reason", "included")


@query(f"{FC} SELECT {_REASON} AS reason, count(*) AS n FROM fx_changes GROUP BY 1")
def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    return selection.decision_summary(_decisions(spark, d))


@query(
    f"""{FC} SELECT new_path, pr, {_LANG} AS lang, {_INDEXED} AS indexable, {_DEFAULT_SKIP} AS default_skip,
regexp_matches(new_path, '^src/.*[^/]\\.ts$') OR regexp_matches(new_path, '^docs/f1') AS user_glob,
regexp_matches(new_path, '_test\\.go$') OR regexp_matches(regexp_extract(new_path, '([^/]*)$', 1), '^f1[0-4]\\.') AS fn_glob,
NOT regexp_matches(new_path, '^vendor/') AND {_INDEXED} AS index_ok,
regexp_matches(new_path, '^(.*/)?vendor/') OR (regexp_matches(new_path, '^(.*/)?docs/') AND NOT regexp_matches(new_path, '^(.*/)?f5\\.md$')) AS ignored,
regexp_matches(lower(new_path), '(^|/)(\\.claude|vendor|node_modules)/') AS non_reviewable FROM fx_changes"""
)
def path_gates(spark: SparkSession, d: str) -> DataFrame:
    """FLT-2/3/4/5/10/12 on every changed path."""
    p = F.col("new_path")
    return fx.changes(fx.findings(spark, d)).select(
        p, "pr", language(p).alias("lang"), selection.indexable(p).alias("indexable"), selection.matches(p, selection.SKIP).alias("default_skip"),
        selection.matches(p, ["src/**/*.ts", "docs/f1*"]).alias("user_glob"), selection.fnmatch_excluded(p, ["*_test.go", "f1[0-4].*"]).alias("fn_glob"),
        selection.index_eligible(p).alias("index_ok"), selection.gitignored(p, ["# docs", "docs/", "!f5.md"]).alias("ignored"), selection.non_reviewable(p).alias("non_reviewable"),
    )


_PARTS = "list_transform(string_split(lower(new_path), '/'), lambda x: regexp_replace(x, '\\.[^./]*$', ''))"
_HAS = lambda words: f"list_has_any({_PARTS}, [{', '.join(repr(w) for w in words)}])"


@query(
    f"""{FC} SELECT owner, repo, pr, new_path, {_HAS(selection.AUTH)} AS auth, {_HAS(selection.MIGRATION)} OR new_path LIKE '%.sql' AS migration,
{_HAS(selection.INFRA)} AS infra, new_path LIKE '%\\_test.go' ESCAPE '\\' AS is_test, CASE WHEN is_deleted THEN old_path ELSE new_path END AS effective,
is_renamed AND ord % 2 = 0 AS pure_rename FROM fx_changes"""
)
def path_buckets(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11, FLT-13: buckets of changed paths; deletions have no new path, and half of the renames change nothing."""
    p = F.col("new_path")
    c = fx.changes(fx.findings(spark, d))
    same = F.col("ord") % 2 == 0
    still = c.withColumn("insertions", F.when(same, 0).otherwise(F.col("insertions"))).withColumn("deletions", F.when(same, 0).otherwise(F.col("deletions")))
    rows = still.select(
        *KEY, p, selection.touches_auth(p).alias("auth"), selection.touches_migration(p).alias("migration"), selection.touches_infra(p).alias("infra"),
        selection.is_test_file(p).alias("is_test"), F.coalesce(selection.is_pure_rename(), F.lit(False)).alias("pure_rename"),
    )
    gone = F.when(same, "/dev/null").otherwise("")
    own = c.withColumn("path", p).withColumn("new_path", F.when(F.col("is_deleted"), gone).otherwise(p))
    return rows.join(own.select(*KEY, F.col("path").alias("new_path"), selection.effective_path().alias("effective")), [*KEY, "new_path"])


@query(
    f"""{FC} SELECT owner, repo, pr, new_path, CASE WHEN is_binary THEN 'binary' WHEN is_deleted THEN 'deleted' WHEN new_path LIKE 'docs/%' THEN 'user_exclude'
  WHEN NOT (new_path LIKE 'src/%' OR new_path LIKE 'docs/%' OR new_path LIKE 'vendor/%') THEN 'not_allowed' WHEN (strlen(diff)+3)//4 > 2500 THEN 'too_large' ELSE '' END AS reason FROM fx_changes"""
)
def selection_with_globs(spark: SparkSession, d: str) -> DataFrame:
    """FLT-1 with a caller's exclude and include globs, which end the static gates."""
    c = fx.changes(fx.findings(spark, d))
    return selection.select_changes(c, exclude=["docs/**"], include=["src/**", "docs/**", "vendor/**"], max_tokens=2500).select(*KEY, "new_path", "reason")


@query(
    f"""{F0}, n AS (SELECT DISTINCT path, pr % 8 AS k FROM fx_findings) SELECT path, k, CASE k WHEN 0 THEN path LIKE '%\\_test.go' ESCAPE '\\' WHEN 7 THEN path LIKE '%\\_test.go' ESCAPE '\\' ELSE true END AS is_test FROM n"""
)
def test_file_names(spark: SparkSession, d: str) -> DataFrame:
    """FLT-11: the conventions for test files."""
    p = F.col("path")
    n = fx.findings(spark, d).select("path", (F.col("pr") % 8).cast("int").alias("k")).distinct()
    forms = [p, F.concat(p, F.lit(".test.ts")), F.concat(F.lit("Tests/"), p), F.lit("a/test_x.py"), F.concat(p, F.lit(".spec.js")), F.lit("x_test.py"), F.concat(F.lit("a/__tests__/"), p), F.concat(p)]
    form = F.element_at(F.array(*forms), F.col("k") + 1)
    return n.select("path", F.col("k").cast("long").alias("k"), selection.is_test_file(form).alias("is_test"))


@query(f"{FC} SELECT owner, repo, pr, new_path, insertions AS added, deletions AS deleted FROM fx_changes")
def churn_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: added and deleted lines by a scan of the diff body; file headers don't count. SRC-1 has the count inside hunks."""
    body = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1 +1 @@\n"), "diff", F.repeat(F.lit("-y\n ctx\n"), F.col("deletions").cast("int")))
    c = fx.changes(fx.findings(spark, d)).withColumn("c", churn(body))
    return c.select(*KEY, "new_path", F.col("c.added").cast("long").alias("added"), F.col("c.deleted").cast("long").alias("deleted"))


@query(
    f"""{FC}, d AS (SELECT *, {_REASON} AS reason FROM fx_changes) SELECT owner, repo, pr,
CASE WHEN bool_and(regexp_matches(lower(new_path), '\\.(md|mdx|rst|txt|adoc)$|(^|/)docs?/')) THEN 'docs' ELSE 'chore' END AS pr_type
FROM d GROUP BY ALL HAVING NOT bool_or(reason = '')"""
)
def chore_change_sets(spark: SparkSession, d: str) -> DataFrame:
    return selection.chore_class(_decisions(spark, d))


def _effort_files(spark: SparkSession, d: str) -> DataFrame:
    return fx.changes(fx.findings(spark, d)).select(
        *KEY, F.col("new_path").alias("path"), "ord", F.col("insertions").alias("lines_added"), F.col("deletions").alias("lines_deleted"), "is_new", "is_renamed",
        selection.is_test_file(F.col("new_path")).alias("is_test"),
    )


_CAP = lambda x, c: f"least({x}, {c}::DOUBLE)"
_EFFORT_SQL = f"""{FS}, {fx.CHANGES_SQL}, fl AS (SELECT *, insertions + deletions AS churn, {_HAS(selection.AUTH)} AS auth, {_HAS(selection.MIGRATION)} OR new_path LIKE '%.sql' AS mig,
  {_HAS(selection.INFRA)} AS infra, new_path LIKE '%\\_test.go' ESCAPE '\\' AS is_test FROM fx_changes),
g AS (SELECT owner, repo, pr, sum(churn)::DOUBLE AS churn, count(*)::DOUBLE AS n, count(*) FILTER (is_new AND NOT is_renamed)::DOUBLE AS fresh, max(churn)::DOUBLE AS top,
  count(*) FILTER (is_test)::DOUBLE AS tests, bool_or(auth) AS auth, bool_or(mig) AS mig, bool_or(infra) AS infra FROM fl GROUP BY ALL),
s AS (SELECT owner, repo, pr, count(*) FILTER (score_severity='CRITICAL') * 1.5::DOUBLE + count(*) FILTER (score_severity='HIGH') * 0.75::DOUBLE
  + count(*) FILTER (score_severity='MEDIUM') * 0.3::DOUBLE + count(*) FILTER (score_severity='LOW') * 0.05::DOUBLE AS pts FROM fx_scored GROUP BY ALL),
r AS (SELECT g.owner, g.repo, g.pr, 0.5::DOUBLE + {_CAP('churn/10.0*0.05', 2.5)} + {_CAP('n*0.05', 1.5)} + {_CAP('fresh*0.1', 1.5)} + {_CAP('top/10.0*0.03', 1.0)}
  + CASE WHEN tests = n THEN 0 WHEN tests/n >= 0.5 THEN -1.0 WHEN tests/n >= 0.25 THEN -0.5 ELSE 0 END
  + CASE WHEN auth THEN 1.5 ELSE 0 END + CASE WHEN mig THEN 1.5 ELSE 0 END + CASE WHEN infra THEN 1.0 ELSE 0 END
  + {_CAP('coalesce(pts,0)', 4.0)} AS raw FROM g LEFT JOIN s USING (owner, repo, pr)),
c AS (SELECT owner, repo, pr, least(10, greatest(0, raw)) AS raw FROM r)
SELECT owner, repo, pr, CAST(round(raw) AS INT) AS value, CASE WHEN round(raw) <= 2 THEN 'trivial' WHEN round(raw) <= 4 THEN 'light' WHEN round(raw) <= 6 THEN 'medium'
  WHEN round(raw) <= 8 THEN 'medium-high' ELSE 'heavy' END AS label, round(raw, 6) AS raw FROM c"""


@query(_EFFORT_SQL)
def effort_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5 over all scored findings."""
    sev = scoring.severity_histogram(_scored(spark, d))
    return effort.effort_scores(_effort_files(spark, d), sev).select(*KEY, "value", "label", F.round("raw", 6).alias("raw"))


@query(_EFFORT_SQL)
def effort_scores_all(spark: SparkSession, d: str) -> DataFrame:
    """The same, under the name it had while effort_scores took a part of the findings."""
    return effort_scores(spark, d)


_HITS = "CASE WHEN n_{k} > 1 THEN p_{k}||' (+'||(n_{k} - 1)||' more)' ELSE p_{k} END"
_AUDIT_SQL = f"""{FS}, {fx.CHANGES_SQL}, fl AS (SELECT *, insertions + deletions AS churn, {_HAS(selection.AUTH)} AS auth, {_HAS(selection.MIGRATION)} OR new_path LIKE '%.sql' AS migration,
  {_HAS(selection.INFRA)} AS infra, new_path LIKE '%\\_test.go' ESCAPE '\\' AS is_test FROM fx_changes),
g AS (SELECT owner, repo, pr, CAST(sum(insertions) AS BIGINT) AS added, CAST(sum(deletions) AS BIGINT) AS deleted, count(*) AS n, count(*) FILTER (is_new AND NOT is_renamed) AS fresh,
  max(churn) AS top, arg_max(new_path, (churn, -ord)) AS top_path, count(*) FILTER (is_test) AS tests,
  count(*) FILTER (auth) AS n_auth, arg_min(new_path, ord) FILTER (auth) AS p_auth, count(*) FILTER (migration) AS n_migration, arg_min(new_path, ord) FILTER (migration) AS p_migration,
  count(*) FILTER (infra) AS n_infra, arg_min(new_path, ord) FILTER (infra) AS p_infra FROM fl GROUP BY ALL),
s AS (SELECT owner, repo, pr, count(*) FILTER (score_severity='CRITICAL') AS c, count(*) FILTER (score_severity='HIGH') AS h, count(*) FILTER (score_severity='MEDIUM') AS m,
  count(*) FILTER (score_severity='LOW') AS l FROM fx_scored GROUP BY ALL),
i AS (SELECT owner, repo, pr, 'Base' AS signal, '' AS detail, 0.5::DOUBLE AS raw, NULL::DOUBLE AS cap FROM g
  UNION ALL SELECT owner, repo, pr, 'LOC churn', '+'||added||' / −'||deleted||' ('||(added + deleted)||' lines)', (added + deleted)::DOUBLE / 10.0 * 0.05, 2.5 FROM g WHERE added + deleted > 0
  UNION ALL SELECT owner, repo, pr, 'Files changed', n||' file(s)', n * 0.05::DOUBLE, 1.5 FROM g
  UNION ALL SELECT owner, repo, pr, 'New files', fresh||' new', fresh * 0.1::DOUBLE, 1.5 FROM g WHERE fresh > 0
  UNION ALL SELECT owner, repo, pr, 'Largest single file', top||' lines in '||top_path, top::DOUBLE / 10.0 * 0.03, 1.0 FROM g WHERE top > 0
  UNION ALL SELECT owner, repo, pr, 'Test file ratio', CAST(round(tests / n * 100) AS INT)||'% ('||tests||' test / '||n||' total)', CASE WHEN tests / n >= 0.5 THEN -1.0 WHEN tests / n >= 0.25 THEN -0.5 ELSE 0 END, NULL FROM g WHERE tests < n
  UNION ALL SELECT owner, repo, pr, 'Auth path touched', {_HITS.format(k='auth')}, 1.5, NULL FROM g WHERE n_auth > 0
  UNION ALL SELECT owner, repo, pr, 'Migration path touched', {_HITS.format(k='migration')}, 1.5, NULL FROM g WHERE n_migration > 0
  UNION ALL SELECT owner, repo, pr, 'Infra path touched', {_HITS.format(k='infra')}, 1.0, NULL FROM g WHERE n_infra > 0
  UNION ALL SELECT owner, repo, pr, 'Findings', c||' CRIT / '||h||' HIGH / '||m||' MED / '||l||' LOW', c * 1.5::DOUBLE + h * 0.75::DOUBLE + m * 0.3::DOUBLE + l * 0.05::DOUBLE, 4.0 FROM s WHERE c + h + m + l > 0)
SELECT owner, repo, pr, signal, detail, round(CASE WHEN raw >= cap THEN cap ELSE raw END, 6) AS points, coalesce(raw >= cap, false) AS capped FROM i WHERE raw <> 0"""


@query(_AUDIT_SQL)
def effort_audit(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5: one row a contribution."""
    e = effort.effort_scores(_effort_files(spark, d), scoring.severity_histogram(_scored(spark, d)))
    c = e.select(*KEY, F.explode("contributions").alias("c"))
    return c.select(*KEY, "c.signal", "c.detail", F.round("c.points", 6).alias("points"), "c.capped")
