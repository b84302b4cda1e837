"""Exact hard-negative mining by a vertical scan with partial bounds (operator 12)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Vector components in a shard and in a group of anchors (8 bytes each).
SHARD_COMPONENTS, ANCHOR_COMPONENTS = 1 << 20, 1 << 16
#: Parts in which a scan reads the dimensions; bounds are tested between them.
PARTS = 4


def relabelled(vectors: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """The table with label (label + 1) % ``classes`` where vec_id is divisible by ``every``."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


def usable(vectors: DataFrame) -> DataFrame:
    """row (unique), id, no_id, label, dim and x = floor(256 * component) of the rows that take part.

    Left out: a null label or vector, and any null or non-finite component. A null vec_id takes
    part as a candidate and sorts last (no_id). Rows that repeat a vec_id are rows of their own.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("label").isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"),
        F.col("vec_id").isNull().alias("no_id"),
        F.col("label").cast("long").alias("label"),
        F.size(x).alias("dim"),
        F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("x"),
    )
    return materialize(rows, "op12-vectors")


class Columns:
    """Vectors by dimension, with the least and greatest value of each."""

    def __init__(self, x: np.ndarray, at: np.ndarray):
        self.x, self.at = x, at
        self.least, self.most = (x.min(axis=1), x.max(axis=1)) if x.shape[1] else (x.sum(axis=1), x.sum(axis=1))

    def only(self, live: np.ndarray) -> Columns:
        return Columns(self.x[:, live], self.at[live])


def vertical_scan(q: np.ndarray, cols: Columns, live: np.ndarray, keep: Callable, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact inner products of the candidates that ``keep`` never rules out.

    Dimensions are read in descending magnitude of the anchor's components. Between parts, the
    least and greatest contribution of what remains bounds each score, and ``keep(low, high)``
    clears bits of the candidates' bitmap ``live``. When under half of the columns are live, only those are
    read on, with bounds of their own.
    """
    order = np.argsort(-np.abs(q).astype(np.float64), kind="stable")
    sums = np.zeros(cols.x.shape[1], q.dtype)
    cuts = [len(order) * i // parts for i in range(parts + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = order[a:b]
        if len(part):
            sums = sums + q[part] @ cols.x[part]
        rest = order[b:]
        if not len(rest) or not len(sums):
            continue
        one, other = q[rest] * cols.least[rest], q[rest] * cols.most[rest]
        low, high = sums[live] + np.minimum(one, other).sum(), sums[live] + np.maximum(one, other).sum()
        live = live.copy()
        live[live] = keep(low, high)
        n = int(live.sum())
        if 2 * n < len(live):
            cols, sums, live = cols.only(live), sums[live], np.ones(n, bool)
    return cols.at[live], sums[live]


def above_kth(k: int) -> Callable:
    """Keeps what may be among the k greatest."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

    return keep


def inside(windows: list[tuple[int, int]], k: int) -> Callable:
    """Keeps what may be among the k greatest of a window [a, b]."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for a, b in windows:
            sure = low[(low >= a) & (high <= b)]
            least = max(a, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else a
            out |= (high >= least) & (low <= b)
        return out

    return keep


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, dim)


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which every partial sum and bound is exact: doubles, longs or Python's integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2.0**52:
        return q, c
    if bound < 2.0**61:
        return q.astype(np.int64), c.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(q), whole(c)


def _long(x) -> int:
    return min(max(int(x), -(2**63)), 2**63 - 1)


FOUND = pa.schema([("a_row", pa.int64()), ("p", pa.int32()), ("shard", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("no_id", pa.bool_()), ("score", pa.int64())])


def _searcher(k: int, limits: tuple[int, int] | None):
    """The search of one tile: the k best of the same label, or of each positive's window in other labels."""

    def run(key, anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and shard.num_rows:
            dim, number = key[0].as_py(), key[2].as_py()
            q, c = _exact(_matrix(anchors, "q", dim), _matrix(shard, "x", dim))
            rows, ids, no_ids, labels = (shard.column(n).to_numpy() for n in ("row", "id", "no_id", "label"))
            everything, by_label = Columns(np.ascontiguousarray(c.T), np.arange(len(rows))), {}
            wanted = anchors.column("scores").to_pylist() if limits else [None] * len(q)
            for v, a_row, label, scores in zip(q, anchors.column("a_row").to_pylist(), anchors.column("a_label").to_pylist(), wanted, strict=True):
                if limits is None:
                    if label not in by_label:
                        by_label[label] = everything.only(labels == label)
                    cols = by_label[label]
                    at, found = vertical_scan(v, cols, rows[cols.at] != a_row, above_kth(k))
                    windows = [(None, None)]
                else:
                    windows = [window_of(s, *limits) for s in scores]
                    open_ = [w for w in windows if w[0] <= w[1]]
                    if not open_:
                        continue
                    at, found = vertical_scan(v, everything, labels != label, inside(open_, k))
                for p, (a, b) in enumerate(windows):
                    pick = np.arange(len(at)) if a is None else np.flatnonzero((found >= a) & (found <= b))
                    if len(pick) > k:  # the k greatest and all that tie with the last of them
                        least = np.partition(found[pick], len(pick) - k)[len(pick) - k]
                        pick = pick[found[pick] >= least]
                    place = at[pick]
                    _, height = np.unique(found[pick], return_inverse=True)
                    for i in np.lexsort((rows[place], ids[place], no_ids[place], -height))[:k]:
                        j = place[i]
                        out.append((a_row, p, number, int(rows[j]), int(ids[j]), bool(no_ids[j]), _long(found[pick[i]])))
        columns = zip(*out, strict=True) if out else [[] for _ in FOUND]
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return run


def _search(data: DataFrame, anchors: DataFrame, k: int, limits: tuple[int, int] | None, shards: int, groups: int, fan_in: int) -> DataFrame:
    """The k best for each (a_row, p) over all shards: tiles, then a tree of merged lists."""
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    mix = F.xxhash64("row")
    left = anchors.select(F.col("dim").alias("a_dim"), F.pmod(F.xxhash64("a_row"), F.lit(groups)).cast("int").alias("grp"), "a_row", "a_label", "q", *(["scores"] if limits else []), all_shards)
    right = data.select("dim", F.pmod(mix, F.lit(shards)).cast("int").alias("shard"), "row", "id", "no_id", "label", "x", all_groups)
    found = (
        left.groupBy("a_dim", "grp", "shard")
        .cogroup(right.groupBy("dim", "grp", "shard"))
        .applyInArrow(_searcher(k, limits), "a_row long, p int, shard int, row long, id long, no_id boolean, score long")
    )

    def best(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("a_row", "p", *by).orderBy(F.desc("score"), "no_id", "id", "row")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    while shards > fan_in:
        shards = -(-shards // fan_in)
        found = best(found.withColumn("shard", F.expr(f"shard div {fan_in}").cast("int")), "shard")
    return best(found)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
    shard_components: int = SHARD_COMPONENTS, anchor_components: int = ANCHOR_COMPONENTS, fan_in: int = 16,
) -> DataFrame:
    """For each anchor and positive: the k best rows of other labels with a score of low to high percent of the positive's.

    Anchors are the rows whose vec_id is divisible by ``every``; their positives are the first
    ``positives`` other rows of their label. Score: integer inner product of floor(256 * x); higher first, then
    smaller vec_id (null last). Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Exact: no candidate is left out but by bounds on its score. See :func:`usable` for bad
    and repeated rows; vectors of different lengths never meet; a score beyond a long is the nearest long; an
    empty table gives an empty result; other columns aren't read.

    Plan: the columnar shards meet groups of anchors in tiles, each one task that scans vertically and
    yields k rows an anchor (and positive) at most; the lists merge by a tree of ``fan_in``. A row is copied once a
    group of anchors, not once an anchor. First the positives, then, with their windows, the negatives.
    """
    data = usable(vectors)
    is_anchor = ~F.col("no_id") & (F.col("id") % every == 0)
    own = F.when(is_anchor, F.col("dim"))
    size, asked, rows = data.agg(F.sum("dim"), F.sum(own), F.count("*")).first()
    cores = data.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-(size or 0) // shard_components), min(cores, -(-rows // 1024)), 1)
    groups = max(1, -(-(asked or 0) // anchor_components))
    anchors = data.where(is_anchor).select(F.col("row").alias("a_row"), F.col("id").alias("a_id"), F.col("label").alias("a_label"), "dim", F.col("x").alias("q"))

    def vec_id(name: str) -> F.Column:
        return F.when(~F.col("no_id"), F.col("id")).alias(name)

    nearest = materialize(
        _search(data, anchors, positives, None, shards, groups, fan_in).select("a_row", (F.col("rank") - 1).alias("p"), vec_id("positive_id"), F.col("score").alias("positive_score")),
        "op12-positives",
    )
    scores = nearest.groupBy("a_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked_for = materialize(anchors.join(scores.hint("merge"), "a_row"), "op12-anchors")
    found = _search(data, asked_for, k, (low, high), shards, groups, fan_in)
    negatives = found.select("a_row", "p", "rank", vec_id("negative_id"), F.col("score").alias("negative_score"))
    return (
        negatives.join(nearest.hint("merge"), ["a_row", "p"])
        .join(anchors.select("a_row", F.col("a_id").alias("anchor_id")).hint("merge"), "a_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


#: The rows of ``hard_negatives`` over relabelled embeddings, in DuckDB SQL.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x, len(embedding) AS dim FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.dim = c.dim AND a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) <= 5),
n AS (SELECT s.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY s.a, p.c ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c) AS INT) AS rank
  FROM s JOIN p ON s.a = p.a WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
