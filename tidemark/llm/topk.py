"""Exact top-k inner products by tiled matrix products (operator 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and floor(256 * x) of every component, x as double, a row each.

    Rows without a vec_id or vector, or with a null or non-finite component, are left out.
    """
    x = F.col(embedding).cast("array<double>")
    ok = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    )
    return vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("x"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of long they saturate."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if bound < 2.0**53:  # every partial sum is an exact double
        return (q @ c.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q) @ exact(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, query_tile: int = 1024, shard_rows: int = 4096, fan_in: int = 16
) -> DataFrame:
    """For each vec_id divisible by ``every``: the k best other vectors by integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a query
    with fewer than k candidates returns all. Rows that repeat a vec_id stay apart: each is a
    candidate of all others, and each query row has a list of its own. Vectors of different lengths
    never meet (each length is searched by itself). See :func:`quantize` for bad rows; an empty table
    gives an empty result; other columns, whatever their names, play no part.

    Plan: queries are dealt into groups of about ``query_tile`` rows and all vectors into shards
    of about ``shard_rows``; each (group, shard) tile is one matrix product in one task, which
    keeps only k rows a query. The lists are merged by a tree of ``fan_in``, so no task ever sees
    all lists of a query. A candidate is copied once per query group, not once per query.
    """
    data = materialize(quantize(vectors).select("*", F.size("x").alias("dim"), F.monotonically_increasing_id().alias("row")), "op4-vectors")
    n, m = data.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, groups = max(1, -(-n // shard_rows)), max(1, -(-m // query_tile))
    mix = F.xxhash64("row")
    every_grp = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    candidates = data.select(
        F.col("dim").alias("c_dim"), F.pmod(mix, F.lit(shards)).cast("int").alias("c_shard"), F.col("vec_id").alias("c_id"), F.col("row").alias("c_row"), F.col("x").alias("c_x"),
        every_grp,
    )
    queries = data.where(F.col("vec_id") % every == 0).select(
        "dim", F.pmod(F.shiftright(mix, 7), F.lit(groups)).cast("int").alias("grp"), F.col("vec_id").alias("q_id"), F.col("row").alias("q_row"),
        F.col("x").alias("q_x"), every_shard,
    )

    def tile(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "shard", "vec_id", "score"]
        if not len(q) or not len(c):
            return pd.DataFrame({x: pd.Series(dtype="int64") for x in names}).astype({"shard": "int32"})
        ids, rows = c["c_id"].to_numpy(), c["c_row"].to_numpy()
        s = _scores(np.stack(q["q_x"].to_numpy()), np.stack(c["c_x"].to_numpy()))
        out = []
        for i, (q_row, q_id) in enumerate(zip(q["q_row"], q["q_id"], strict=True)):
            row = s[i]
            keep = np.flatnonzero(rows != q_row)
            if len(keep) > k:  # partial selection, then all that tie with the k-th
                part = row[keep]
                keep = keep[part >= np.partition(part, len(part) - k)[len(part) - k]]
            order = keep[np.lexsort((ids[keep], -row[keep]))][:k]
            out.append((np.full(len(order), q_row), np.full(len(order), q_id), ids[order], row[order]))
        r, a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_row": r, "query_id": a, "shard": np.full(len(a), int(key[2])), "vec_id": b, "score": d})

    lists = (
        queries.groupBy("dim", "grp", "shard")
        .cogroup(candidates.groupBy("c_dim", "grp", "c_shard"))
        .applyInPandas(tile, "query_row long, query_id long, shard int, vec_id long, score long")
    )

    def best(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("query_row", *by).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    while shards > fan_in:
        shards = -(-shards // fan_in)
        lists = best(lists.withColumn("shard", F.expr(f"shard div {fan_in}").cast("int")), "shard")
    return best(lists).select("query_id", "rank", "vec_id", "score")
