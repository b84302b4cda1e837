"""Continuous reconciliation of findings as pushes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.findings import reconcile_pushes
from tidemark.operators.scoring import KEY
from tidemark.sources.versions import Store

TABLES = {
    "findings": "owner string, repo string, pr long, fingerprint string, path string, ord long, state string, first_seen long, last_seen long, push long",
    "pushes": "owner string, repo string, pr long, push long",
}
#: Commits between two snapshots of the whole state.
COMPACT_EVERY = 32


def state_store(spark: SparkSession, state_dir: str, compact_every: int = COMPACT_EVERY) -> Store:
    return Store(spark, state_dir, KEY, TABLES, compact_every=compact_every)


def reconcile_stream(pushes: DataFrame, state_dir: str, checkpoint: str, compact_every: int = COMPACT_EVERY, available_now: bool = False):
    """STR-1: a streaming query that folds pushes into the store at ``state_dir``, in their order.

    ``pushes``: key, push (a long that orders the pushes of a change set; without the column, a batch is one
    push of each), fingerprint, path, ord, seen. A row without a fingerprint names a path that the push
    changed and that has no finding, so a file without findings resolves what it had. A batch may hold any
    number of pushes of a change set, and each push must come whole in one batch. A push that is not
    newer than the last one folded is old (a replay, or late) and is left out.

    The touched change sets are replaced by one commit under the batch's number; a batch that is run again
    after its commit changes nothing, and one that failed before it left no trace.
    """

    def fold(batch: DataFrame, number: int) -> None:
        store = state_store(batch.sparkSession, state_dir, compact_every)
        if "push" not in batch.columns:
            batch = batch.withColumn("push", F.lit(number))
        batch = batch.select(*KEY, F.col("push").cast("long").alias("push"), "fingerprint", "path", "ord", "seen").persist()
        try:
            buckets = store.touched(batch)
            known = store.read("pushes", buckets).select(*KEY, F.col("push").alias("folded"))
            new = batch.join(known.hint("merge"), list(KEY), "left").where("folded is null or push > folded").drop("folded")
            state = reconcile_pushes(store.read("findings", buckets), new)
            last = new.groupBy(*KEY).agg(F.max("push").alias("push"))
            store.replace({"findings": state, "pushes": last}, last, tag=f"{checkpoint}:{number}")
        finally:
            batch.unpersist()

    writer = pushes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_state(spark: SparkSession, state_dir: str, buckets: list[int] | None = None) -> DataFrame:
    """The findings of every change set after its last push: key, fingerprint, path, ord, state, first_seen, last_seen, push, batch (the commit)."""
    return state_store(spark, state_dir).read("findings", buckets, version=True).withColumnRenamed("_version", "batch")
