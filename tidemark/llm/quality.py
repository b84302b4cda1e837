"""Quality selection by importance resampling with hashed n-grams (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kth_largest, materialize, with_text

BUCKETS = 16_384
#: Target doc_ids that may be broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1_000_000


class HashedNgrams:
    """Bucket counts of hashed words and word pairs of a text; word hashes in a bounded memo."""

    def __init__(self, buckets: int = BUCKETS, size: int = 100_000):
        self.buckets, self.size, self.memo = np.uint64(buckets), size, {}

    def __call__(self, text: str) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.size:
            memo.clear()
        tokens = text.lower().split()
        for t in set(tokens).difference(memo):
            memo[t] = xxhash.xxh3_64_intdigest(t)
        w = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        pairs = (w[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:] + (w[:-1] >> np.uint64(7)))
        return np.concatenate([w % self.buckets, (pairs ^ (pairs >> np.uint64(33))) % self.buckets]).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all n-grams of all rows. Each task sums its own; ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, total = HashedNgrams(buckets), np.zeros(buckets, np.int64)
        for pdf in batches:
            for t in pdf["text"].tolist():
                total += np.bincount(grams(t), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    got = texts.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r.bucket] = r.n
    return out


def gumbel(doc_id, text, seed: int) -> F.Column:
    """Gumbel noise fixed by the row itself, so reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(-F.log(u))


def importance_scores(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, broadcast_ids: int = BROADCAST_IDS, seed: int = 3) -> DataFrame:
    """doc_id, log_weight, gumbel_key of every document.

    log_weight sums log p_target / p_raw over the text's hashed words and word pairs. The target
    model counts every document labelled quality 1, the raw model all documents; both add one
    count a bucket. Null and empty texts weigh 0. Without target documents all weights are 0.
    The target ids are broadcast up to ``broadcast_ids``; beyond, the texts meet them in a
    shuffle on doc_id.
    """
    good = materialize(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "op3-target")
    good = F.broadcast(good) if good.count() <= broadcast_ids else good.hint("merge")
    rows = with_text(docs)
    target = bucket_counts(rows.join(good, "doc_id", "left_semi"), buckets) + 1.0
    raw = bucket_counts(rows, buckets) + 1.0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > buckets else np.zeros(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = HashedNgrams(buckets)
        for b in batches:
            w = [float(ratio[grams(t)].sum()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("noise"), pa.array(w, pa.float64())], ["doc_id", "noise", "log_weight"])

    src = rows.withColumn("noise", gumbel(F.col("doc_id"), F.col("text"), seed))
    out = src.mapInArrow(run, "doc_id long, noise double, log_weight double")
    return out.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, **options) -> DataFrame:
    """The k documents with the greatest log_weight + Gumbel noise: a sample without replacement.

    k is ``share`` of all rows; by default the share of quality 1 among the labels, so as many
    documents stay as the labels call good. Returns doc_id, log_weight, gumbel_key. Rows that tie
    with the k-th key all stay (repeated rows have equal keys). The k-th key is found by
    narrowing histograms, never by a global sort.
    """
    if share is None:
        share = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality").isNotNull(), 0.0))).first()[0] or 0.0
    scored = materialize(importance_scores(docs, labels, **options), "op3-scores", waves=16)
    k = int(round(share * scored.count()))
    least = kth_largest(scored, "gumbel_key", k)
    return scored.where(F.col("gumbel_key") >= F.lit(least)) if least is not None else scored.limit(0)
