"""Findings, changes, references and files derived from the star-schema tables.

These stand in for review data: the same derivations are given in SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two review runs of findings from ``events``, keyed by owner, repo, pr, run_id; ``ord`` orders them."""
    return findings_of(table(spark, sf_dir, "events"))


def pushes_of(found: DataFrame) -> DataFrame:
    """Findings as pushes of their change sets: fifty ids a push; every fourth row only says that its path changed."""
    mark = F.concat_ws("|", "category", "path")
    return found.select(
        "owner", "repo", "pr", F.expr("ord div 50").alias("push"), F.when(F.col("ord") % 4 != 0, mark).alias("fingerprint"), "path", "ord", F.col("ord").alias("seen")
    )


PUSHES_SQL = """fx_pushes AS (SELECT owner, repo, pr, ord // 50 AS push, CASE WHEN ord % 4 <> 0 THEN category||'|'||path END AS fingerprint, path, ord, ord AS seen FROM fx_findings)"""


def findings_of(events: DataFrame) -> DataFrame:
    e = events.select(
        "event_id", "event_type", "value", "user_id", F.expr("user_id div 8").alias("pr"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("user_id") % 23).cast("string").alias("m"),
    )
    by = (F.col("user_id") % 10).cast("int")
    seven = (F.col("user_id") % 7).cast("string")
    m = F.col("m")
    path = (
        F.when(by == 0, F.concat(F.lit("vendor/lib"), m, F.lit(".go")))
        .when(by == 1, F.concat(F.lit("src/auth/f"), m, F.lit(".py")))
        .when(by == 2, F.concat(F.lit("db/migrations/f"), m, F.lit(".sql")))
        .when(by == 3, F.concat(F.lit("deploy/k8s/f"), m, F.lit(".yaml")))
        .when(by == 4, F.concat(F.lit("pkg/m"), seven, F.lit("/f"), m, F.lit("_test.go")))
        .when(by == 5, F.concat(F.lit("docs/f"), m, F.lit(".md")))
        .otherwise(F.concat(F.lit("src/m"), seven, F.lit("/f"), m, F.lit(".ts")))
    )
    kinds = {"error": "bug.null-deref", "signup": "security", "purchase": "security.hardcoded-secret", "view": "style"}
    category = F.lit("made-up")
    for k, v in kinds.items():
        category = F.when(F.col("event_type") == k, v).otherwise(category)
    v = F.col("value")
    severity = F.when(v >= 100, "critical").when(v >= 50, "high").when(v >= 20, "medium").when(v >= 5, "low").otherwise("info")
    return e.select(
        F.lit("acme").alias("owner"), F.concat(F.lit("r"), (F.col("pr") % 5).cast("string")).alias("repo"), "pr",
        F.when(F.col("event_id") % 1000 >= 500, 2).otherwise(1).alias("run_id"), F.col("event_id").alias("ord"), path.alias("path"),
        category.alias("category"), severity.alias("severity"),
        F.when(F.col("event_id") % 5 == 0, "scanner:gitleaks").otherwise("llm").alias("source"),
        F.col("k").alias("start_line"), F.col("k").alias("end_line"), F.concat("event_type", F.lit(" finding")).alias("content"),
        F.lit("").alias("existing_code"), "value",
    )


FINDINGS_SQL = """
e AS (SELECT *, user_id // 8 AS pr, CAST(json_extract_string(props,'$.k') AS INT) AS k, user_id % 23 AS m FROM events),
fx_findings AS (SELECT 'acme' AS owner, 'r'||(pr%5) AS repo, pr,
  CASE WHEN event_id%1000 >= 500 THEN 2 ELSE 1 END AS run_id, event_id AS ord,
  CASE user_id%10 WHEN 0 THEN 'vendor/lib'||m||'.go' WHEN 1 THEN 'src/auth/f'||m||'.py'
    WHEN 2 THEN 'db/migrations/f'||m||'.sql' WHEN 3 THEN 'deploy/k8s/f'||m||'.yaml'
    WHEN 4 THEN 'pkg/m'||(user_id%7)||'/f'||m||'_test.go' WHEN 5 THEN 'docs/f'||m||'.md'
    ELSE 'src/m'||(user_id%7)||'/f'||m||'.ts' END AS path,
  CASE event_type WHEN 'error' THEN 'bug.null-deref' WHEN 'signup' THEN 'security' WHEN 'purchase' THEN 'security.hardcoded-secret'
    WHEN 'view' THEN 'style' ELSE 'made-up' END AS category,
  CASE WHEN value>=100 THEN 'critical' WHEN value>=50 THEN 'high' WHEN value>=20 THEN 'medium' WHEN value>=5 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN event_id%5=0 THEN 'scanner:gitleaks' ELSE 'llm' END AS source,
  k AS start_line, k AS end_line, event_type||' finding' AS content, '' AS existing_code, value FROM e)"""


def changed_paths(found: DataFrame) -> DataFrame:
    """Paths that the second run changed."""
    return found.where((F.col("run_id") == 2) & ((F.length("path") + F.col("pr")) % 3 != 0)).select("owner", "repo", "pr", "path").distinct()


CHANGED_SQL = "fx_changed AS (SELECT DISTINCT owner, repo, pr, path FROM fx_findings WHERE run_id = 2 AND (length(path) + pr) % 3 <> 0)"


def changes(found: DataFrame) -> DataFrame:
    """One file change a path: diff text, churn and flags."""
    total = F.floor(F.round(F.sum("value"), 2))
    return (
        found.groupBy("owner", "repo", "pr", F.col("path").alias("new_path"))
        .agg(total.cast("long").alias("insertions"), F.count("*").alias("deletions"), F.min("ord").alias("first"))
        .select(
            "owner", "repo", "pr", "new_path", F.concat(F.lit("old/"), "new_path").alias("old_path"),
            F.repeat(F.lit("+x\n"), F.col("insertions").cast("int")).alias("diff"), "insertions", "deletions",
            (F.col("first") % 11 == 0).alias("is_binary"), (F.col("first") % 7 == 0).alias("is_deleted"),
            (F.col("first") % 3 == 0).alias("is_new"), (F.col("first") % 5 == 0).alias("is_renamed"), F.col("first").alias("ord"),
        )
    )


CHANGES_SQL = """fx_changes AS (SELECT owner, repo, pr, path AS new_path, 'old/'||path AS old_path,
  repeat('+x'||chr(10), CAST(floor(round(sum(value),2)) AS INT)) AS diff,
  CAST(floor(round(sum(value),2)) AS BIGINT) AS insertions, CAST(count(*) AS BIGINT) AS deletions,
  min(ord)%11=0 AS is_binary, min(ord)%7=0 AS is_deleted, min(ord)%3=0 AS is_new, min(ord)%5=0 AS is_renamed, min(ord) AS ord
  FROM fx_findings GROUP BY owner, repo, pr, path)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between files of two repositories from ``events``: paths are ids, the same ones in both."""
    repo = F.when(F.col("event_id") % 5 < 2, "a").otherwise("b")
    k = F.get_json_object("props", "$.k").cast("int").cast("long")
    sym = F.when(F.col("event_id") % 3 == 0, "view").when(F.col("event_id") % 3 == 1, "click").otherwise("error")
    return (
        table(spark, sf_dir, "events")
        .select(repo.alias("repo"), F.col("user_id").alias("source_path"), F.col("event_type").alias("source_symbol"), k.alias("target_path"), sym.alias("target_symbol"))
        .where("source_path <> target_path")
        .distinct()
    )


REFS_SQL = """fx_refs AS (SELECT DISTINCT CASE WHEN event_id%5 < 2 THEN 'a' ELSE 'b' END AS repo, user_id AS source_path, event_type AS source_symbol,
  CAST(CAST(json_extract_string(props,'$.k') AS INT) AS BIGINT) AS target_path,
  CASE event_id%3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'error' END AS target_symbol
  FROM events WHERE user_id <> CAST(json_extract_string(props,'$.k') AS INT)),
fx_symbols AS (SELECT DISTINCT repo, source_path AS file_path, source_symbol AS name FROM fx_refs),
fx_imports AS (SELECT DISTINCT repo, source_path, target_path FROM fx_refs)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files from ``documents``."""
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.substring("text", 1, 40)).alias("summary"),
        "doc_id", "lang", F.col("source").alias("repo"),
    )


FILES_SQL = """fx_files AS (SELECT source||'/'||lang||'/d'||doc_id||'.md' AS path, text AS content,
  CASE WHEN doc_id%4=0 THEN '' ELSE left(text,40) END AS summary, doc_id, lang, source AS repo FROM documents)"""


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change sets from ``documents``: title and changed paths (distinct longer lines) in one repo a language."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 10))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("repo"), F.col("doc_id").alias("number"), F.array_join(F.slice(words, 1, 12), " ").alias("title"), lines.alias("paths")
    )


PRS_SQL = r"""fx_prs AS (SELECT lang AS repo, doc_id AS number,
  array_to_string(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')[1:12], ' ') AS title,
  list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) > 10)) AS paths FROM documents)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review runs from ``orders``."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("repo"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice").cast("double") / 1e6).alias("total_cost_usd"),
        (k % 60000).alias("duration_ms"), (k % 7).alias("new_findings"), (k % 5).alias("carried_findings"),
        F.when(k % 3 == 0, 0).otherwise(k % 11).alias("effort_score"), k.alias("ord"),
    )


RUNS_SQL = """fx_runs AS (SELECT o_custkey%10 AS repo, o_orderdate AS ts, CAST(o_totalprice AS DOUBLE)/1e6 AS total_cost_usd,
  o_orderkey%60000 AS duration_ms, o_orderkey%7 AS new_findings, o_orderkey%5 AS carried_findings,
  CASE WHEN o_orderkey%3=0 THEN 0 ELSE o_orderkey%11 END AS effort_score, o_orderkey AS ord FROM orders)"""
