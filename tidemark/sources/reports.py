"""Scanner reports as findings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import empty, redact_match, strip_ws

_LEAK = "array<struct<RuleID: string, Description: string, File: string, StartLine: int, Match: string, Secret: string>>"
_SEMGREP = "struct<results: array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<message: string, severity: string, lines: string>>>>"


def _relative(path: Column, root: Column) -> Column:
    p, base = F.regexp_replace(empty(path), r"^\./", ""), F.concat(F.regexp_replace(empty(root), "/+$", ""), F.lit("/"))
    return F.when((base != "/") & p.startswith(base), F.substring(p, F.length(base) + 1, F.length(p))).otherwise(p)


def gitleaks_findings(reports: DataFrame) -> DataFrame:
    """SRC-6: findings of JSON-array reports (``report_id``, ``root``, ``body``); secrets are masked."""
    r = reports.select("report_id", "root", F.explode(F.from_json("body", _LEAK)).alias("f"))
    text = F.when(empty(F.col("f.Description")) != "", F.col("f.Description")).otherwise(F.concat(F.lit('gitleaks rule "'), empty(F.col("f.RuleID")), F.lit('" matched')))
    return r.select(
        "report_id", F.lit("gitleaks").alias("tool"), F.col("f.RuleID").alias("rule_id"), _relative(F.col("f.File"), F.col("root")).alias("path"),
        F.coalesce("f.StartLine", F.lit(0)).alias("line"), F.lit("secret").alias("kind"), F.lit("HIGH").alias("severity"), text.alias("description"),
        redact_match(empty(F.col("f.Match")), empty(F.col("f.Secret"))).alias("evidence"),
    )


def semgrep_findings(reports: DataFrame) -> DataFrame:
    """SRC-7: findings of reports (``report_id``, ``body``); unknown severities count as medium."""
    r = reports.select("report_id", F.explode(F.from_json("body", _SEMGREP)["results"]).alias("f"))
    sev = F.upper(strip_ws(empty(F.col("f.extra.severity"))))
    return r.select(
        "report_id", F.lit("semgrep").alias("tool"), F.col("f.check_id").alias("rule_id"), F.col("f.path").alias("path"), F.coalesce("f.start.line", F.lit(0)).alias("line"),
        F.lit("sast").alias("kind"), F.when(sev == "ERROR", "HIGH").when(sev == "INFO", "INFO").otherwise("MEDIUM").alias("severity"),
        F.when(empty(F.col("f.extra.message")) != "", F.col("f.extra.message")).otherwise(F.col("f.check_id")).alias("description"),
        strip_ws(empty(F.col("f.extra.lines"))).alias("evidence"),
    )


_VULN = (
    "osv struct<id: string, summary: string>, finding struct<osv: string, trace: array<struct<module: string, package: string, "
    "function: string, position: struct<filename: string, line: int>>>>"
)


def json_messages(streams: DataFrame) -> DataFrame:
    """report_id, line_no, value: the JSON objects that follow each other in ``body``, over several lines or not.

    What doesn't parse is skipped up to the next line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder().raw_decode
        for pdf in batches:
            out = []
            for report, body in zip(pdf["report_id"], pdf["body"], strict=True):
                at, body = 0, body or ""
                while (m := re.compile(r"\S").search(body, at)) is not None:
                    try:
                        value, at = decode(body, m.start())
                        out.append((report, m.start(), json.dumps(value)))
                    except ValueError:
                        at = body.find("\n", m.start()) + 1 or len(body)
            yield pd.DataFrame(out, columns=["report_id", "line_no", "value"])

    kind = streams.schema["report_id"].dataType.simpleString()
    return streams.select("report_id", "body").mapInPandas(run, f"report_id {kind}, line_no long, value string")


def govulncheck_findings(messages: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC-8: findings that reach the user's own code, once for each vulnerability, file and line.

    ``messages``: report_id, line_no, value (one JSON object); ``roots``: report_id, root, module.
    The first step of the trace that has a file and is of ``module`` counts; where that is unknown,
    the first whose file is relative (but not below src/) or below the root. The description is the
    summary of the vulnerability's last entry in the report, else its id.
    """
    m = messages.select("report_id", "line_no", F.from_json("value", _VULN).alias("m"))
    about = m.where("m.osv is not null").groupBy("report_id", F.col("m.osv.id").alias("rule_id")).agg(F.max_by("m.osv.summary", "line_no").alias("summary"))
    f = m.where("m.finding is not null").select("report_id", "line_no", F.col("m.finding.osv").alias("rule_id"), F.col("m.finding.trace").alias("trace"))
    root, module = empty(F.col("root")), empty(F.col("module"))

    def own(step: Column) -> Column:
        name = empty(step["position"]["filename"])
        near = (~name.startswith("/") & ~name.startswith("src/")) | name.startswith(root)
        return (name != "") & F.when(module != "", F.coalesce(step["module"] == module, F.lit(False))).otherwise(near)

    f = f.join(roots.select("report_id", "root", "module").hint("merge"), "report_id").withColumn("step", F.get(F.filter("trace", own), F.lit(0))).where("step is not null")
    name, line = F.col("step.position.filename"), F.coalesce("step.position.line", F.lit(0))
    first = f.groupBy("report_id", "rule_id", name.alias("name"), line.alias("line")).agg(F.min_by(F.struct("root", "step"), "line_no").alias("x"))
    d = first.join(about.hint("merge"), ["report_id", "rule_id"], "left")
    return d.select(
        "report_id", F.lit("govulncheck").alias("tool"), "rule_id", _relative(F.col("name"), F.col("x.root")).alias("path"), "line", F.lit("cve").alias("kind"),
        F.lit("HIGH").alias("severity"), F.when(empty(F.col("summary")) != "", F.col("summary")).otherwise(F.col("rule_id")).alias("description"),
        strip_ws(F.concat(empty(F.col("x.step.package")), F.lit("."), empty(F.col("x.step.function")))).alias("evidence"),
    )
