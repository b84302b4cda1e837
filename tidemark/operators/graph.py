"""Import and call graphs: inbound edges, blast radius, neighbours."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import strip_ws
from tidemark.sources.shared import written


#: A symbol with more callers than this is a hub: its callers are dealt out by salts of about so many.
HUB = 100_000


def inbound_edges(paths: DataFrame, imports: DataFrame, refs: DataFrame) -> DataFrame:
    """AGG-4: repo, path, n_inbound: imports of a path plus distinct files that refer to it; 0 if none.

    All three tables have ``repo``: equal paths of two repositories are two files.
    """
    i = imports.groupBy("repo", F.col("target_path").alias("path")).agg(F.count("*").alias("i"))
    r = refs.groupBy("repo", F.col("target_path").alias("path")).agg(F.countDistinct("source_path").alias("r"))
    out = paths.select("repo", "path").distinct().join(i, ["repo", "path"], "left").join(r, ["repo", "path"], "left")
    return out.select("repo", "path", (F.coalesce("i", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("n_inbound"))


def rank_by_inbound(changed: DataFrame, inbound: DataFrame, *by: str) -> DataFrame:
    """TOP-1: paths of each change set (repo and ``by``) by inbound edges, most first, ties in input order (``ord``)."""
    w = Window.partitionBy("repo", *by).orderBy(F.desc("n_inbound"), "ord")
    out = changed.join(inbound, ["repo", "path"], "left").withColumn("n_inbound", F.coalesce("n_inbound", F.lit(0)))
    return out.withColumn("rank", F.row_number().over(w))


def salted_calls(refs: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Calls with a salt by their caller, and repo, target_path, target_symbol, salts of the hubs (others have one salt, 0)."""
    target = ["repo", "target_path", "target_symbol"]
    calls = refs.select(*target, "source_path", "source_symbol").distinct()
    hubs = written(calls.groupBy(*target).agg(F.count("*").alias("n")).where(F.col("n") > hub).select(*target, F.ceil(F.col("n") / hub).cast("int").alias("salts")), "hubs")
    salt = F.pmod(F.xxhash64("source_path", "source_symbol"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")
    return written(calls.join(hubs.hint("merge"), target, "left").select(*target, "source_path", "source_symbol", salt.alias("salt")), "calls"), hubs


def blast_radius(seeds: DataFrame, symbols: DataFrame, refs: DataFrame, hops: int | None = 2, hub: int = HUB) -> DataFrame:
    """JON-9: files that call into the seeds, directly or through other callers.

    ``seeds``: seed_id, repo, path. ``symbols``: repo, file_path, name. ``refs``: repo, source_path, source_symbol,
    target_path, target_symbol. Returns seed_id, repo, path, depth, symbols (sorted). A path appears
    once, at its least depth; calls stay inside a repository. ``hops`` None: until no new file is found.

    All seed sets advance together, and only with what the last hop found (semi-naive). Each hop is one
    equality join, whose new callers are written once to the shared folder: the next hop, the visited files and the
    result read that table. Targets with more than ``hub`` callers are spread over salts, so a symbol that
    everything calls is no task of its own.
    """
    target = ["repo", "target_path", "target_symbol"]
    calls, hubs = salted_calls(refs, hub)
    visited = seeds.select("seed_id", "repo", "path").distinct()
    front = visited.join(symbols.select("repo", F.col("file_path").alias("path"), F.col("name").alias("symbol")).distinct(), ["repo", "path"])
    levels, depth = [], 0
    while hops is None or depth < hops:
        depth += 1
        f = front.select("seed_id", "repo", F.col("path").alias("target_path"), F.col("symbol").alias("target_symbol")).join(hubs.hint("merge"), target, "left")
        f = f.select("seed_id", *target, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        hit = f.hint("merge").join(calls, [*target, "salt"]).select("seed_id", "repo", F.col("source_path").alias("path"), F.col("source_symbol").alias("symbol")).distinct()
        front = written(hit.join(visited.hint("merge"), ["seed_id", "repo", "path"], "left_anti"), f"hop-{depth}")
        levels.append(front.groupBy("seed_id", "repo", "path").agg(F.array_sort(F.collect_set("symbol")).alias("symbols")).withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        visited = visited.unionByName(front.select("seed_id", "repo", "path").distinct())
    return functools.reduce(DataFrame.unionByName, levels).select("seed_id", "repo", "path", "depth", "symbols")


def one_hop(changed: DataFrame, imports: DataFrame, *by: str) -> DataFrame:
    """JON-17: distinct import targets of changed files that are not changed themselves.

    ``changed``: repo, path and the key columns ``by`` of a change set (none: one a repository); all change
    sets are looked up together. ``imports``: repo, source_path, target_path.
    """
    c = changed.select(*by, "repo", F.col("path").alias("source_path")).distinct()
    hit = imports.select("repo", "source_path", F.col("target_path").alias("path")).join(c, ["repo", "source_path"]).select(*by, "repo", "path").distinct()
    return hit.join(c.withColumnRenamed("source_path", "path"), [*by, "repo", "path"], "left_anti")


def importers(changed: DataFrame, imports: DataFrame, cap: int = 20, *by: str) -> DataFrame:
    """JON-11, files: unchanged files that import a changed path, at most ``cap`` a target, in path order.

    Tables and ``by`` as in :func:`one_hop`. :func:`package_importers` has the form by package with its lines.
    """
    c = changed.select(*by, "repo", F.col("path").alias("target_path")).distinct()
    hit = imports.join(c, ["repo", "target_path"]).select(*by, "repo", "source_path", "target_path").distinct()
    hit = hit.join(c.withColumnRenamed("target_path", "source_path"), [*by, "repo", "source_path"], "left_anti")
    w = Window.partitionBy(*by, "repo", "target_path").orderBy("source_path")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def package_importers(changed: DataFrame, files: DataFrame, modules: DataFrame, cap: int = 20, most_lines: int = 8) -> DataFrame:
    """JON-11: Go files that import a changed package, with the lines that use it.

    ``changed``: change_id, repo, path. ``files``: repo, path, content. ``modules``: repo, module.
    Packages are the folders of changed Go files that are no tests; importers are files whose text
    holds the quoted import path, outside the package's folder, no tests, and not changed
    themselves. The first ``cap`` of each change set by path (then package) stay, each with its
    first ``most_lines`` lines that hold the package's name and a dot ('7: x.Do()'). Returns
    change_id, repo, path, package, lines.
    """
    go = lambda c: c.endswith(".go") & ~c.endswith("_test.go")
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    packages = changed.where(go(F.col("path"))).select("change_id", "repo", folder(F.col("path")).alias("package")).distinct()
    packages = packages.join(modules.where("module <> ''").select("repo", "module").distinct().hint("merge"), "repo")
    packages = packages.withColumn("import", F.concat_ws("/", "module", F.when(F.col("package") != "", F.col("package"))))
    code = files.where(go(F.col("path")) & F.col("content").contains('"'))
    quoted = code.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r'"([^"\\\s]+)"'), F.lit(1)))).alias("import"))
    hit = quoted.join(packages.hint("merge"), ["repo", "import"]).where(folder(F.col("path")) != F.col("package"))
    hit = hit.join(changed.select("change_id", "repo", "path").distinct().hint("merge"), ["change_id", "repo", "path"], "left_anti")
    w = Window.partitionBy("change_id", "repo").orderBy("path", "package")
    hit = hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    used = hit.select("change_id", "repo", "path", "package").join(files.select("repo", "path", "content").hint("merge"), ["repo", "path"])
    needle = F.concat(F.regexp_extract("package", "([^/]*)$", 1), F.lit("."))
    rows = F.transform(F.split("content", "\n"), lambda x, k: F.struct((k + 1).alias("n"), x.alias("line")))
    rows = F.slice(F.filter(rows, lambda x: x["line"].contains(F.col("needle"))), 1, most_lines)
    text = F.transform(rows, lambda x: F.concat(x["n"].cast("string"), F.lit(": "), strip_ws(x["line"])))
    return used.withColumn("needle", needle).select("change_id", "repo", "path", "package", text.alias("lines"))


def capped_graph(edges: DataFrame, cap: int = 24) -> DataFrame:
    """TOP-5: edges among the first ``cap`` nodes of each graph, alphabetically, and how many nodes are left out."""
    nodes = edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", F.col("dst").alias("node"))).distinct()
    r = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy("node")))
    more = r.groupBy("graph_id").agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("n_more"))
    keep = r.where(F.col("rank") <= cap).select("graph_id", "node")
    out = edges.join(keep.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_semi")
    return out.distinct().join(more, "graph_id")
