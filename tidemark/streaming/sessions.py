"""Usage totals of session logs as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sessions import records, usage_totals


def session_totals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """STR-2: a streaming DataFrame of :func:`usage_totals` over the log files that come to ``folder``.

    Files are read once, so logs belong there when their session is closed; several files of a
    session add up. Write it in update mode: each batch gives the new totals of the sessions it
    touched. State holds one row a session.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return usage_totals(records(lines.select("value")))


#: What a session comes to, in the order of :func:`usage_totals`.
TOTALS = "prompt_tokens long, completion_tokens long, cache_read_tokens long, cache_write_tokens long, llm_failures long, tool_calls long, tool_failures long"
COUNTS = tuple(c.split()[0] for c in TOTALS.split(", "))


def session_records(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """SRC-5 as a stream: the records of the log files that come to ``folder``, with event_time.

    A record's time is its timestamp, else the modification time of its file. A file is read once: what is
    written to it later is not seen, so a log that goes on belongs in a new file.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    recs = records(lines.select("value", F.col("_metadata.file_modification_time").alias("file_time")))
    return recs.withColumn("event_time", F.coalesce(F.try_to_timestamp("timestamp"), "file_time")).drop("file_time")


def closed_sessions(recs: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """STR-2: :func:`usage_totals` of each session, once, when it is over; to be written in append mode.

    ``recs``: a stream of records with event_time. A session is over with its session_end, or when the watermark
    (the latest event_time less ``delay``) passes its last record by ``gap``; then ``closed`` is false. An open
    session yields nothing. Records behind the watermark are late and left out, as are those without a time, and so are records of a session that
    has yielded, until the watermark passes it by ``gap``; those of a later time begin a session anew.

    State holds the sums of the open sessions and eight bytes for each of their files, and a mark for each of
    those that ended within ``gap``; nothing stays of the others.
    """
    spark = recs.sparkSession
    wait = int(spark.sql(f"SELECT cast(interval {gap} AS interval day to second) AS i").first().i.total_seconds() * 1000)
    is_a = lambda t: (F.col("type") == t).cast("long")
    tokens = [F.when(F.col("type") == "llm_response", F.col(f"usage.{c}")) for c in COUNTS[:4]]
    facts = [
        *tokens, is_a("llm_error"), is_a("tool_call"), is_a("tool_call") * (~F.col("ok")).cast("long"),
        F.when(F.col("filePath") != "", F.xxhash64("filePath")), is_a("session_end"), F.unix_millis("event_time"),
    ]
    # one array: a session's call converts its columns one by one, which takes longer than its rows
    facts = F.array(*[F.coalesce(c, F.lit(0).cast("long")) for c in facts]).alias("facts")
    rows = recs.where("event_time is not null").withWatermark("event_time", delay).select("session", "event_time", facts)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def row(sums, files, closed):
            return pd.DataFrame([(key[0], *sums, len(files), closed)], columns=["session", *COUNTS, "n_files", "closed"])

        if state.hasTimedOut:
            sums, files, _, over = state.get
            state.remove()
            if not over:
                yield row(sums, files, False)
            return
        sums, files, last, over = state.get if state.exists else ([0] * len(COUNTS), [], 0, False)
        sums, files, ends = list(sums), set(files), False
        for b in batches:
            if not over and len(b):
                *counts, file, end, at = np.stack(b["facts"].to_numpy()).T
                sums = [s + int(c.sum()) for s, c in zip(sums, counts, strict=True)]
                files.update(x for x in file.tolist() if x)
                last, ends = max(last, int(at.max())), ends or bool(end.any())
        if ends:
            yield row(sums, files, True)
            sums, files, over = [0] * len(COUNTS), set(), True
        state.update((sums, sorted(files), last, over))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("session").applyInPandasWithState(
        step, f"session string, {TOTALS}, n_files int, closed boolean", "sums array<long>, files array<long>, last long, over boolean", "append", "EventTimeTimeout"
    )
