"""Maintenance of a code index as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import basename, empty, parent_dir
from tidemark.sources.versions import Store


def content_hash(files: DataFrame) -> DataFrame:
    """FUN-6."""
    return files.withColumn("content_hash", F.sha2(empty(F.col("content")), 256))


def needs_work(files: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """JON-3: rows whose (repo, path, content_hash) isn't stored."""
    return files if full else files.join(stored.select("repo", "path", "content_hash"), ["repo", "path", "content_hash"], "left_anti")


def missing_rows(paths: DataFrame, stored: DataFrame) -> DataFrame:
    """JON-4."""
    return paths.join(stored.select("repo", "path"), ["repo", "path"], "left_anti")


def prune(tables: dict[str, DataFrame], live: DataFrame) -> dict[str, DataFrame]:
    """JON-5: each table (keyed by repo, path) without rows of vanished paths."""
    return {name: t.join(live.select("repo", "path"), ["repo", "path"], "left_semi") for name, t in tables.items()}


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """JON-6, rows: the newest row of each (repo, path) by ``ord`` replaces the stored one."""
    w = Window.partitionBy("repo", "path").orderBy(F.desc("ord"))
    latest = new.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return old.join(latest.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(latest)


def replace_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """JON-6, children: symbols of re-read files are replaced; the first of a name stays, blank names go."""
    w = Window.partitionBy("repo", "path", "name").orderBy("ord")
    clean = new.where(F.trim(empty(F.col("name"))) != "").withColumn("kind", F.when(empty(F.col("kind")) == "", "function").otherwise(F.col("kind")))
    clean = clean.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return old.join(new.select("repo", "path").distinct(), ["repo", "path"], "left_anti").unionByName(clean)


def replace_packages(old: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """JON-7: packages of re-read files are replaced, those of dead files cleared; the last of a name stays.

    ``old`` and ``new``: repo, file_path, name, kind and more; ``live``: repo, file_path. A file is its
    repository and path, so equal paths elsewhere are untouched.
    """
    file = ["repo", "file_path"]
    w = Window.partitionBy(*file, "name", "kind").orderBy(F.desc("ord"))
    latest = new.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    kept = old.join(new.select(*file).distinct().hint("merge"), file, "left_anti").join(live.select(*file).distinct().hint("merge"), file, "left_semi")
    return kept.unionByName(latest)


def stored_index(spark: SparkSession, path: str, tables: dict[str, T.StructType | str], key: tuple[str, ...] = ("repo", "path")) -> Store:
    """JON-6, JON-7: the tables of an index (files, symbols, imports, ...), which change together, file by file.

    All hold ``key``. ``replace(rows, keys)`` puts new rows of the files ``keys`` in all tables by one commit:
    children of a re-read file go with it, and a vanished file is a key without rows.
    """
    return Store(spark, path, key, tables)


def directory_rollup(files: DataFrame, cap: int = 30) -> DataFrame:
    """AGG-8: file count of each directory and the summary lines of its first ``cap`` paths."""
    d = files.select("repo", "path", "summary", parent_dir(F.col("path")).alias("dir"))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy("repo", "dir").orderBy("path")))
    line = F.when((F.col("nth") <= cap) & (empty(F.col("summary")) != ""), F.struct("nth", F.concat(F.lit("- "), basename(F.col("path")), F.lit(": "), "summary").alias("line")))
    g = d.groupBy("repo", "dir").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(line)).alias("l"))
    return g.where(F.size("l") > 0).select("repo", "dir", "n_files", F.transform("l", lambda x: x["line"]).alias("lines"))


def batches(files: DataFrame, n: int = 3, large: int = 5000) -> DataFrame:
    """WIN-4: large files alone, the others in batches of ``n`` in path order."""
    big = F.octet_length(empty(F.col("content"))) >= large
    d = files.select("repo", "path", big.alias("is_large"))
    at = F.row_number().over(Window.partitionBy("repo", "is_large").orderBy("path")) - 1
    return d.withColumn("batch", F.when(F.col("is_large"), at).otherwise(F.floor(at / n)).cast("long"))
