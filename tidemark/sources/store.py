"""Tables of findings by change set, and the result document of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scoring import KEY
from tidemark.sources import versions


def findings_store(spark: SparkSession, path: str, schema: T.StructType) -> versions.Store:
    return versions.Store(spark, path, KEY, {"findings": schema})


def write_findings(findings: DataFrame, keys: DataFrame, path: str) -> None:
    """SRC-4: replace the findings of the change sets in ``keys`` (owner, repo, pr) by one commit; others stay.

    Change sets are dealt into buckets, so there is no folder for each; a write that fails leaves
    what was there. Keys may not be null.
    """
    findings_store(findings.sparkSession, path, findings.schema).replace({"findings": findings}, keys)


def read_findings(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame | None = None) -> DataFrame:
    """SRC-4: the stored findings; a store that doesn't exist is empty. ``keys``: of these change sets, from their buckets only."""
    stored = findings_store(spark, path, schema)
    if keys is None:
        return stored.read("findings")
    return stored.read("findings", stored.touched(keys)).join(keys.select(*KEY).distinct(), list(KEY), "left_semi")


def envelopes(sessions: DataFrame, comments: DataFrame) -> DataFrame:
    """SNK-2: session_id, document: one JSON text a session, to be written with ``.write.text`` or as a table.

    ``comments``: session_id, ord (their order) and the fields of a comment, the reconciled state and
    the score among them; nulls, empty texts and zero scores are left out, a session without
    comments has an empty list. ``sessions``: session_id and optional overlap (array), summary and
    labels (structs), which are left out if nothing in them is set.
    """
    fields = [c for c in comments.columns if c not in ("session_id", "ord")]
    optional = {"state", "severity", "confidence", "impact", "rationale"}
    zero = lambda c: F.lit("") if isinstance(comments.schema[c].dataType, T.StringType) else F.lit(0)
    body = F.struct(*[(F.nullif(F.col(c), zero(c)) if c in optional else F.col(c)).alias(c) for c in fields])
    listed = comments.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", body.alias("body")))).alias("rows"))
    empty = F.from_json(F.lit("[]"), T.ArrayType(_body_type(comments, fields)))
    d = sessions.join(listed, "session_id", "left")
    parts = [F.col("session_id"), F.coalesce(F.transform("rows", lambda r: r["body"]), empty).alias("comments")]
    if "overlap" in sessions.columns:
        parts.append(F.when(F.size("overlap") > 0, F.col("overlap")).alias("overlap"))
    for c in ("summary", "labels"):
        if c in sessions.columns:
            inside = sessions.schema[c].dataType.fields
            some = [F.size(F.col(f"{c}.{f.name}")) > 0 if isinstance(f.dataType, T.ArrayType) else F.col(f"{c}.{f.name}") != "" for f in inside]
            parts.append(F.when(F.greatest(*[F.coalesce(x, F.lit(False)) for x in some], F.lit(False)), F.col(c)).alias(c))
    return d.select("session_id", F.to_json(F.struct(*parts)).alias("document"))


def _body_type(comments: DataFrame, fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, comments.schema[c].dataType) for c in fields])
