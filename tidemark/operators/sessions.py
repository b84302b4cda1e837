"""Session logs: records, resume points and usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields of all record types; a record has those of its type.
RECORD = (
    "type string, sessionId string, timestamp string, filePath string, taskType string, request_no int, model string, duration_ms long, "
    "error string, tool_name string, arguments string, result string, ok boolean, fingerprint string, comments string, "
    "files_reviewed int, duration_seconds double, llm_failures int, "
    "usage struct<total_tokens: long, prompt_tokens: long, completion_tokens: long, cache_read_tokens: long, cache_write_tokens: long>"
)


def records(lines: DataFrame) -> DataFrame:
    """SRC-5: the records of log lines (``value``, other columns stay); lines that don't parse are dropped."""
    other = [c for c in lines.columns if c != "value"]
    parsed = lines.withColumn("r", F.from_json("value", f"{RECORD}, bad string", {"columnNameOfCorruptRecord": "bad"}))
    return parsed.where("r is not null and r.bad is null").select(*other, "r.*").drop("bad").withColumnRenamed("sessionId", "session")


def resume_items(recs: DataFrame) -> DataFrame:
    """SRC-11: session, fingerprint, comments: the latest finished or reused item of each fingerprint."""
    done = recs.where(F.col("type").isin("review_item_done", "review_item_reused") & (F.col("fingerprint") != ""))
    return done.groupBy("session", "fingerprint").agg(F.max_by(F.coalesce("comments", F.lit("")), "line_no").alias("comments"))


def usage_totals(recs: DataFrame) -> DataFrame:
    """AGG-16: one row a session: token sums, model failures, tool calls and failures, files, whether it ended.

    Works on batches and on streams.
    """
    is_a = lambda t: F.col("type") == t
    tokens = [
        F.coalesce(F.sum(F.when(is_a("llm_response"), F.col(f"usage.{c}"))), F.lit(0)).alias(c)
        for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")
    ]
    return recs.groupBy("session").agg(
        *tokens,
        F.count_if(is_a("llm_error")).alias("llm_failures"),
        F.count_if(is_a("tool_call")).alias("tool_calls"),
        F.count_if(is_a("tool_call") & ~F.col("ok")).alias("tool_failures"),
        F.size(F.collect_set(F.when(F.col("filePath") != "", F.col("filePath")))).alias("n_files"),
        (F.count_if(is_a("session_end")) > 0).alias("closed"),
    )


def tool_counts(recs: DataFrame) -> DataFrame:
    """AGG-16: calls of each tool in each session."""
    return recs.where("type = 'tool_call'").groupBy("session", "tool_name").agg(F.count("*").alias("n_calls"))


def tool_failures(recs: DataFrame) -> DataFrame:
    """AGG-16: failed calls with their number among the session's calls."""
    w = Window.partitionBy("session").orderBy("line_no")
    calls = recs.where("type = 'tool_call'").withColumn("call_no", F.row_number().over(w))
    return calls.where("not ok").select("session", "call_no", "tool_name", F.col("filePath").alias("file_path"), "arguments", F.col("result").alias("error"))

_INTS = ("duration_ms", "prompt_tokens", "completion_tokens", "files_reviewed", "comments_posted", "scanner_findings", "carried_findings", "resolved_findings", "new_findings", "effort_score")
METRICS = (*_INTS, "total_cost_usd")
_LINE = ", ".join([*(f"{c} long" for c in _INTS), "total_cost_usd double", "time timestamp", "timestamp timestamp", "duration_seconds double", "bad string"])


def text_metrics(payload: Column) -> Column:
    """FUN-9: the fields of ``duration=1.2s files=8 tokens=in:1/out:2 cost=$0.1 findings=new:1/carried:2/resolved:3 scanner=1 comments=2``.

    A key that is missing is null, one that isn't a number 0; of a repeated key the last counts.
    """

    def token(key: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(payload, F.lit(rf"(?:^|\s){key}=(\S*)"), F.lit(1)), F.lit(-1))

    def part(key: str, sub: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(token(key), F.lit(rf"(?:^|/){sub}:([^/]*)"), F.lit(1)), F.lit(-1))

    def number(c: Column, kind: str = "long") -> Column:
        return F.when(c.isNotNull(), F.coalesce(c.try_cast(kind), F.lit(0).cast(kind)))

    span = token("duration")
    seconds = (number(F.regexp_replace(span, "s$", ""), "double") * 1000).cast("long")
    took = F.when(span.endswith("ms"), number(F.regexp_replace(span, "ms$", ""))).when(span.endswith("s"), seconds).when(span.isNotNull(), F.lit(0))
    return F.struct(
        took.cast("long").alias("duration_ms"), number(token("files")).alias("files_reviewed"), number(part("tokens", "in")).alias("prompt_tokens"),
        number(part("tokens", "out")).alias("completion_tokens"), number(F.regexp_replace(token("cost"), r"^\$", ""), "double").alias("total_cost_usd"),
        number(part("findings", "new")).alias("new_findings"), number(part("findings", "carried")).alias("carried_findings"),
        number(part("findings", "resolved")).alias("resolved_findings"), number(token("scanner")).alias("scanner_findings"), number(token("comments")).alias("comments_posted"),
        F.lit(None).cast("long").alias("effort_score"),
    )


def run_metrics(lines: DataFrame, mark: str = r"\[\w+\] metrics: (.+)$") -> DataFrame:
    """AGG-6: one row a log file: file, timestamp and the run's figures.

    ``lines``: file, line_no, value, modified. A JSON line of stage metrics sets every figure, a text
    line those it names; of several the last counts. The closing record of a session fills the
    files and the duration only where they still are 0 at its line. The time is that of the last
    opening record, else of the first metrics line, else of the file. Files without any such line
    give no row. One aggregation by file; a line is parsed once, and only if it is of a kind above.
    """
    v = F.col("value")
    kind = (
        F.when(v.contains('"stage":"metrics"'), "json").when(v.contains('"type":"session_start"'), "start")
        .when(v.contains('"type":"session_end"'), "end").when(v.rlike(mark), "text")
    )
    d = lines.withColumn("kind", kind).where("kind is not null")
    d = d.withColumn("j", F.when(F.col("kind") != "text", F.from_json("value", _LINE, {"columnNameOfCorruptRecord": "bad"})))
    d = d.withColumn("t", F.when(F.col("kind") == "text", text_metrics(F.regexp_extract("value", mark, 1))))
    parsed = F.col("j").isNotNull() & F.col("j.bad").isNull()
    is_json = (F.col("kind") == "json") & parsed
    d = d.where((F.col("kind") != "json") | is_json).where((F.col("kind") != "start") | F.col("j.timestamp").isNotNull())
    sets = {c: F.when(is_json, F.coalesce(F.col(f"j.{c}"), F.lit(0))).otherwise(F.col(f"t.{c}")) for c in METRICS}
    figures = [F.max_by(F.struct(F.col("line_no").alias("at"), s.alias("x")), F.when(s.isNotNull(), F.col("line_no"))).alias(c) for c, s in sets.items()]
    end = F.struct("line_no", F.col("j.files_reviewed").alias("files_reviewed"), (F.col("j.duration_seconds") * 1000).cast("long").alias("duration_ms"))
    g = d.groupBy("file").agg(
        *figures,
        F.array_sort(F.collect_list(F.when((F.col("kind") == "end") & parsed, end))).alias("ends"),
        F.max_by("j.timestamp", F.when(F.col("kind") == "start", F.col("line_no"))).alias("started"),
        F.min_by("j.time", F.when(is_json & F.col("j.time").isNotNull(), F.col("line_no"))).alias("logged"),
        F.max("modified").alias("modified"),
    )

    def figure(c: str) -> Column:
        x = F.coalesce(F.col(f"{c}.x"), F.lit(0))
        if c not in ("files_reviewed", "duration_ms"):
            return x.alias(c)
        later = F.filter("ends", lambda e: (e["line_no"] > F.coalesce(F.col(f"{c}.at"), F.lit(-1))) & (e[c] > 0 if c == "duration_ms" else e[c] != 0))
        return F.when(x != 0, x).otherwise(F.coalesce(F.get(later, F.lit(0))[c], F.lit(0))).alias(c)

    return g.select("file", F.coalesce("started", "logged", "modified").alias("timestamp"), *[figure(c) for c in METRICS])
