"""Queries over source files and manifests, each with the SQL of what they must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import context, graph, imports, scoring, selection
from tidemark.operators.scoring import KEY
from tidemark.plans.review_queries import F0
from tidemark.sources import code, manifests, snapshot
from tidemark.sources import fixtures as rx
from tidemark.sources import code_fixtures as fx
from tidemark.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PATH = fx.PATH_SQL.format(o="o")
R0 = f"WITH RECURSIVE {fx.ROWS_SQL}"


@query(
    R0 + """SELECT DISTINCT repo, CASE form WHEN 0 THEN '@s/'||nm WHEN 1 THEN '@s/'||nm WHEN 3 THEN '@s/'||nm WHEN 9 THEN 'v/'||nm WHEN 10 THEN 'v/'||nm WHEN 11 THEN 'x.y/'||nm
    WHEN 12 THEN CASE WHEN dev THEN nm ELSE 'reg:5000/'||nm END ELSE nm END AS name,
  CASE WHEN form < 4 THEN 'npm' WHEN form < 9 THEN 'pip' WHEN form < 11 THEN 'composer' WHEN form = 11 THEN 'go' ELSE 'docker' END AS kind,
  CASE form WHEN 0 THEN '^'||v WHEN 4 THEN CASE WHEN dev THEN '=='||v ELSE '>='||v END WHEN 5 THEN CASE WHEN dev THEN '== '||v ELSE '>='||v END WHEN 8 THEN '=='||v
    WHEN 9 THEN '^'||v WHEN 11 THEN 'v'||v WHEN 12 THEN CASE WHEN dev THEN '' ELSE v END ELSE v END AS version,
  'd'||o||'/'||CASE form WHEN 0 THEN 'package.json' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN 'yarn.lock' WHEN 3 THEN 'pnpm-lock.yaml'
    WHEN 4 THEN CASE WHEN o % 2 = 0 THEN 'requirements-dev.txt' ELSE 'requirements.txt' END WHEN 5 THEN 'pyproject.toml' WHEN 6 THEN 'uv.lock' WHEN 7 THEN 'poetry.lock'
    WHEN 8 THEN 'Pipfile.lock' WHEN 9 THEN 'composer.json' WHEN 10 THEN 'composer.lock' WHEN 11 THEN 'go.mod' ELSE 'Dockerfile' END AS file_path,
  CASE WHEN form IN (2, 3, 6, 7, 12) THEN false WHEN form = 4 THEN o % 2 = 0 ELSE dev END AS is_dev
FROM fx_rows WHERE NOT (form = 7 AND dev)"""
)
def manifest_packages(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9 over one manifest an order, in all thirteen formats."""
    return manifests.packages(fx.manifest_files(spark, d)).distinct()


@query(
    R0 + f"""SELECT repo, {PATH} AS path, nm AS name,
  CASE lang WHEN 2 THEN 'interface' WHEN 4 THEN 'method' WHEN 6 THEN 'method' WHEN 8 THEN 'struct' ELSE 'function' END AS kind,
  CASE lang WHEN 0 THEN nm||'(a, b)' WHEN 3 THEN nm||'(a)' WHEN 4 THEN '(s *T) '||nm||'(a int)' WHEN 5 THEN nm||'(a: u8)' ELSE nm END AS signature
FROM fx_rows UNION ALL SELECT DISTINCT repo, {PATH}, 's', 'variable', 's' FROM fx_rows WHERE lang = 4"""
)
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """EXT-1: declarations in nine languages."""
    return code.symbols(code.code_lines(fx.code_files(spark, d))).drop("ord")


@query(
    R0 + f"""SELECT DISTINCT repo, {PATH} AS path, unnest(CASE lang
  WHEN 0 THEN ['pkg.m'||x||'.'||nm, 'pkg.m'||x, '.m'||x||'.y', '.m'||x] WHEN 1 THEN ['./m'||x] WHEN 2 THEN ['../web/m'||x] WHEN 3 THEN ['./m'||x]
  WHEN 4 THEN ['{fx.GO_MODULE}/go/m'||x] WHEN 5 THEN ['crate::m'||x||'::A', 'crate::m'||x||'::b', 'crate::m'||x||'::b::C']
  WHEN 6 THEN ['com.acme.p'||(x % 5)||'.M'||x] WHEN 7 THEN ['m'||x||'.hpp'] ELSE ['inc/m'||x||'.h'] END) AS import FROM fx_rows"""
)
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    """EXT-1: raw imports in nine languages."""
    return code.imports(code.code_lines(fx.code_files(spark, d))).select("repo", "path", "import")


@query(
    R0 + f""", files AS (SELECT DISTINCT repo, o FROM fx_rows)
SELECT DISTINCT r.repo, {fx.PATH_SQL.format(o='r.o')} AS path, CASE lang WHEN 0 THEN 'pkg.m'||x WHEN 1 THEN './m'||x WHEN 2 THEN '../web/m'||x WHEN 3 THEN './m'||x
  WHEN 4 THEN '{fx.GO_MODULE}/go/m'||x WHEN 5 THEN 'crate::m'||x||'::' WHEN 6 THEN 'com.acme.p'||(x % 5)||'.M'||x WHEN 7 THEN 'm'||x||'.hpp' ELSE 'inc/m'||x||'.h' END AS import,
  {fx.PATH_SQL.format(o='f.o')} AS target, 1 AS choice
FROM fx_rows r JOIN files f ON f.repo = r.repo AND f.o = r.x"""
)
def import_targets(spark: SparkSession, d: str) -> DataFrame:
    """JON-10: the files that the imports of all files mean."""
    files = fx.code_files(spark, d)
    return imports.resolved_imports(files, files.select("repo", "path"), fx.go_modules(spark, d))


_EDGES = f"""edges AS (SELECT DISTINCT repo, CASE lang WHEN 0 THEN 'pkg' WHEN 2 THEN 'app' ELSE 'go/m'||o END AS src,
  CASE lang WHEN 0 THEN 'pkg/m'||x WHEN 2 THEN 'web/m'||x ELSE 'go/m'||x END AS dst FROM fx_rows WHERE lang IN (0, 2) OR (lang = 4 AND x <> o))"""


@query(f"{R0}, {_EDGES} SELECT * FROM edges")
def package_edges(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11: import edges between packages."""
    return imports.package_edges(fx.code_files(spark, d), fx.go_modules(spark, d))


@query(
    f"""{R0}, {_EDGES}, nodes AS (SELECT repo, src AS package FROM edges UNION SELECT repo, dst FROM edges),
ranked AS (SELECT repo, package, CAST(row_number() OVER (PARTITION BY repo ORDER BY package) AS INT) AS rank, count(*) OVER (PARTITION BY repo) AS n_packages FROM nodes)
SELECT * FROM ranked WHERE rank <= 24"""
)
def package_nodes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, TOP-5: the first packages of each repository's import graph."""
    return imports.package_nodes(imports.package_edges(fx.code_files(spark, d), fx.go_modules(spark, d)))


@query(
    R0 + f""", files AS (SELECT DISTINCT repo, o FROM fx_rows WHERE lang = 4), hits AS (SELECT DISTINCT t.o // 64 AS change_id, r.repo, r.o, t.o AS pkg FROM fx_rows r JOIN files t ON t.repo = r.repo AND t.o = r.x
  WHERE r.lang = 4 AND r.o <> t.o AND r.o // 64 <> t.o // 64)
SELECT change_id, repo, 'go/m'||o||'/main.go' AS path, 'go/m'||pkg AS package FROM hits QUALIFY row_number() OVER (PARTITION BY change_id, repo ORDER BY 'go/m'||o||'/main.go', 'go/m'||pkg) <= 20"""
)
def package_importers(spark: SparkSession, d: str) -> DataFrame:
    """JON-11: importers of the packages that a change set of neighbouring files touches."""
    files = fx.code_files(spark, d)
    number = F.regexp_extract("path", r"m(\d+)", 1).cast("long")
    changed = files.where(F.col("path").startswith("go/")).select(F.floor(number / 64).alias("change_id"), "repo", "path")
    return graph.package_importers(changed, files, fx.go_modules(spark, d)).select("change_id", "repo", "path", "package")


_TREE = """CASE doc_id % 6 WHEN 0 THEN '.git/' WHEN 1 THEN 'a/node_modules/x/' WHEN 2 THEN 'pkg/_' WHEN 3 THEN '.config/' ELSE 'src/' END||'d'||doc_id||'.py'"""


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """One tar archive for every fifty documents."""
    import io
    import tarfile

    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                body = text.encode()
                info = tarfile.TarInfo(f"./{path}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return pd.DataFrame({"repo": [pdf["repo"].iloc[0]], "content": [out.getvalue()]})

    prefix = F.when(F.col("doc_id") % 6 == 0, ".git/").when(F.col("doc_id") % 6 == 1, "a/node_modules/x/").when(F.col("doc_id") % 6 == 2, "pkg/_").when(F.col("doc_id") % 6 == 3, ".config/").otherwise("src/")
    docs = rx.table(spark, d, "documents").select(
        F.concat(F.lit("r"), F.expr("doc_id div 50").cast("string")).alias("repo"), F.concat(prefix, F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return docs.groupBy("repo").applyInPandas(pack, "repo string, content binary")


@query(f"""SELECT 'r'||(doc_id // 50) AS repo, {_TREE} AS path, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 6 > 1 AND strlen(coalesce(text, '')) <= 8000""")
def snapshot_tree(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3: files of archived repositories, hidden names included."""
    return snapshot.repository_tree(snapshot.archived_files(_archives(spark, d), max_bytes=8000))


@query(
    R0 + f""", files AS (SELECT DISTINCT repo, o FROM fx_rows), f AS (SELECT repo, {PATH} AS path, o % 4 AS k FROM files)
SELECT repo, path, CASE k WHEN 0 THEN path LIKE '%.py' OR path LIKE '%.go' WHEN 1 THEN path LIKE 'web/%' OR path LIKE 'go/%' WHEN 2 THEN path LIKE '%.ts' AND NOT path LIKE '%2.ts' ELSE false END AS ignored FROM f"""
)
def ignored_by_repo(spark: SparkSession, d: str) -> DataFrame:
    """FLT-5: ignore rules of each repository."""
    rules = [("r0", 1, "*.py"), ("r0", 2, "*.go"), ("r1", 1, "# c"), ("r1", 2, "/web/"), ("r1", 3, "go/"), ("r1", 4, "!web/"), ("r2", 1, "*.ts"), ("r2", 2, "!*2.ts")]
    table = spark.createDataFrame(rules, "repo string, ord int, line string")
    return selection.gitignored_by_repo(fx.code_files(spark, d).select("repo", "path"), table)


@query(
    f"""{F0}, n AS (SELECT DISTINCT owner, repo, pr FROM fx_findings) SELECT n.owner, n.repo, n.pr, count(f.ord) AS n_gitleaks, CAST(0 AS BIGINT) AS n_semgrep, CAST(0 AS BIGINT) AS n_govulncheck
FROM n LEFT JOIN (SELECT * FROM fx_findings WHERE source = 'scanner:gitleaks' AND pr % 2 = 0) f USING (owner, repo, pr) GROUP BY ALL"""
)
def zero_filled_tally(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9 with change sets that have no findings."""
    f = rx.findings(spark, d)
    return scoring.scanner_tally(f.where("pr % 2 = 0"), change_sets=f.select(*KEY))


@query(
    f"""{F0} SELECT ord, ord % 4 = 1 AS legacy, NOT (severity = 'low' AND category IN ('style','maintainability','test','documentation') AND ord % 3 = 0) AS blocks FROM fx_findings"""
)
def posted_comments(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, FLT-9: comments of the old form, and findings that block."""
    f = rx.findings(spark, d).withColumn("suggestion_code", F.when(F.col("ord") % 3 == 0, "x()").otherwise(" "))
    far = F.concat(F.lit("**["), F.repeat(F.lit("é"), F.lit(50)), F.lit(" / b]** t"))
    kinds = [F.concat(F.lit("**[low / bug]** "), "content", F.lit("\n<!-- review:fp:ab -->")), F.concat(F.lit("\n **[low / bug]** "), "content"), F.lit("**[low]** x"), far]
    body = F.element_at(F.array(*kinds), (F.col("ord") % 4 + 1).cast("int"))
    some = scoring.blocking(f).select("ord", F.lit(True).alias("blocks"))
    return f.select("ord", scoring.is_unmarked_comment(body).alias("legacy")).join(some, "ord", "left").select("ord", "legacy", F.coalesce("blocks", F.lit(False)).alias("blocks"))


@query(
    R0 + f""", c AS (SELECT DISTINCT repo, o // 64 AS pr, o AS importer, x AS ord, 'go/m'||x||'/main.go' AS path, 100 + x % 900 AS size FROM fx_rows WHERE lang = 4),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, pr, path ORDER BY importer, ord) = 1),
b AS (SELECT *, CAST(strlen('### `'||path||'` (imported by `m'||importer||'.go`)') + 1 + 5 + 1 + size + 1 + 3 AS BIGINT) AS n_bytes, row_number() OVER (PARTITION BY repo, pr ORDER BY importer, ord) AS k FROM u),
w AS (SELECT repo, pr, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS stopped, false AS ok FROM (SELECT DISTINCT repo, pr FROM b)
  UNION ALL SELECT b.repo, b.pr, b.k, w.used + CASE WHEN t.ok THEN b.n_bytes ELSE 0 END, w.n + CASE WHEN t.ok THEN 1 ELSE 0 END,
    CASE WHEN NOT t.ok AND w.n < 8 THEN b.importer ELSE w.stopped END, t.ok
  FROM w JOIN b ON b.repo = w.repo AND b.pr = w.pr AND b.k = w.k + 1, LATERAL (SELECT w.n < 8 AND w.used < 3000 AND (w.stopped IS NULL OR w.stopped <> b.importer) AND w.used + b.n_bytes <= 3000 AS ok) t)
SELECT b.repo, b.pr, b.path, b.n_bytes, w.n AS rank FROM w JOIN b ON b.repo = w.repo AND b.pr = w.pr AND b.k = w.k WHERE w.ok"""
)
def import_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """WIN-5c: excerpts of what the Go files of a change set import, until 3000 bytes."""
    c = fx.code_files(spark, d).where("path like 'go/%'")
    number = F.regexp_extract("path", r"m(\d+)", 1).cast("long")
    raw = imports.raw_imports(c).select("repo", number.alias("o"), F.regexp_extract("import", r"m(\d+)$", 1).cast("long").alias("x")).distinct()
    candidates = raw.select(
        F.lit("acme").alias("owner"), "repo", F.expr("o div 64").alias("pr"), F.col("o").alias("importer_ord"), F.col("x").alias("ord"), F.concat(F.lit("m"), "o", F.lit(".go")).alias("importer"),
        F.concat(F.lit("go/m"), "x", F.lit("/main.go")).alias("path"), F.expr("repeat('a', cast(100 + x % 900 as int))").alias("content"),
    )
    got = context.import_excerpts(candidates, budget=3000)
    return got.select("repo", "pr", "path", "n_bytes", "rank")


@query()
def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """WIN-6: context of each change set of Go files (a file and its importers share a set); its source part depends on all before it, so tests compare with a plain version."""
    files = written(fx.code_files(spark, d).where("path like 'go/%'"), "go-files").withColumn("owner", F.lit("acme"))
    number = F.regexp_extract("path", r"m(\d+)", 1).cast("long")
    edges = imports.raw_imports(files).select("repo", F.col("path").alias("source_path"), F.concat(F.lit("go/m"), F.regexp_extract("import", r"m(\d+)$", 1), F.lit("/main.go")).alias("target_path"))
    edges = written(edges.distinct(), "go-imports")
    inbound = edges.groupBy("repo", F.col("target_path").alias("path")).agg(F.count("*").alias("n_inbound"))
    changed = files.select("owner", "repo", F.floor(number / 64).alias("pr"), "path", number.alias("ord")).join(inbound, ["repo", "path"], "left").fillna(0, ["n_inbound"])
    blast = changed.select(*KEY, F.col("path").alias("target_path")).join(edges, ["repo", "target_path"]).groupBy(*KEY, F.col("source_path").alias("path"))
    blast = blast.agg(F.count("*").alias("n_symbols"), F.lit(1).alias("depth"))
    summaries = files.select("repo", "path", F.concat(F.lit("about "), "path").alias("summary"))
    dirs = files.select("repo", F.regexp_extract("path", "^(.*)/", 1).alias("path"), F.lit("a package").alias("summary"), F.lit(1).alias("n_files"))
    return context.context_sections(changed, blast, files.select("repo", "path", "content"), summaries, edges, dirs, tokens=600)
