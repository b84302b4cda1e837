"""Helpers shared by the corpus operators: shared scratch tables and exact selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of ``[^\\x20\\x09-\\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is taken on one machine (``local`` masters, as
    in tests); a cluster's executors would not share it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, waves: int = 4) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of recomputing Python
    stages) and gives the optimizer real sizes for what follows. The table is written by ``waves``
    tasks a core at most, without a shuffle: intermediate tables are small against the corpus, and
    thousands of tiny files cost more than they hold. Passes over whole texts take 16, so a task
    stays a small part of the work; 0 keeps the partitions, for tasks that go by their number.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(waves * spark.sparkContext.defaultParallelism) if waves else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """At most ``rows`` rows an Arrow batch for the jobs that run inside, so whole texts of few rows
    are in a Python worker at once; the session's own setting returns afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and ``keep``, nothing else, so extra columns can't clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def crc_fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5 (null: 0, as for the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def kth_largest(df: DataFrame, column: str, k: int, finish: int = 2000) -> float | None:
    """The exact k-th largest value of a double column, by narrowing histograms.

    Each round counts 512 equal bins of the interval that holds the k-th value: the driver
    sees 512 counts, no rows. The last interval holds at most ``finish`` rows or one value.
    Nulls and NaN take no part. None if there are fewer than ``k`` values or ``k`` < 1.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while lo < hi:
        inside = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
        if n <= finish:
            return inside.orderBy(F.desc("x")).limit(k - above).agg(F.min("x")).first()[0]
        step = (hi - lo) / 512
        if not step or lo + step == lo:
            break
        rows = (
            inside.groupBy(F.least(F.lit(511), F.floor((F.col("x") - lo) / step)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for r in rows:
            if above + r.n >= k:
                lo, hi, n = r.a, r.b, r.n
                break
            above += r.n
    return lo


def check_columns(df: DataFrame, need: Iterable[str]) -> None:
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
