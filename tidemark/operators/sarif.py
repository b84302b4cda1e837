"""SARIF 2.1.0 export: one JSON document a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import empty

SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"


def level(severity: Column) -> Column:
    """FUN-7: SARIF level of a severity; null for suppressed findings."""
    s = F.upper(empty(severity))
    return F.when(s.isin("CRITICAL", "HIGH"), "error").when(s == "LOW", "note").when(s == "SUPPRESS", F.lit(None)).otherwise("warning")


def rule_catalogue(findings: DataFrame) -> DataFrame:
    """AGG-17: the first finding of each rule describes it; suppressed findings count here."""
    rule = F.concat_ws("/", "source", "rule_id")
    return findings.groupBy("run", rule.alias("id")).agg(F.min_by(F.struct("rule_id", "description", "severity"), "ord").alias("f"))


def encode(findings: DataFrame, tool: str = "review", version: str = "1") -> DataFrame:
    """SNK-1: run, sarif. ``findings``: run, ord, source, rule_id, path, start_line, end_line, severity, description, fingerprint.

    Rules are sorted by id, results keep ``ord``. A finding without a line has no region; an end
    line shows only behind the start. A run of suppressed findings has an empty result list.
    """
    rules = rule_catalogue(findings).select(
        "run",
        F.struct("id", F.col("f.rule_id").alias("name"), F.struct(F.col("f.description").alias("text")).alias("shortDescription"),
                 F.when(level(F.col("f.severity")).isNotNull(), F.struct(level(F.col("f.severity")).alias("level"))).alias("defaultConfiguration")).alias("rule"),
    ).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("rule.id", "rule"))).alias("rules"))
    region = F.when(F.col("start_line") > 0, F.struct(F.col("start_line").alias("startLine"), F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")).alias("endLine")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.concat_ws("/", "source", "rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.when(empty(F.col("fingerprint")) != "", F.struct(F.col("fingerprint").alias("primary"))).alias("fingerprints"),
    )
    shown = F.when(level(F.col("severity")).isNotNull(), F.struct("ord", result.alias("result")))
    results = findings.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["result"]).alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", lambda x: x["rule"]).alias("rules"))
    log = F.struct(
        F.lit(SCHEMA_URI).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))).alias("runs")
    )
    return results.join(rules, "run").select("run", F.to_json(log).alias("sarif"))


def violations(documents: DataFrame) -> DataFrame:
    """SNK-3: run, violation of SARIF documents: version, runs, rule ids, levels, lines, result lists."""
    kind = "struct<version: string, runs: array<struct<results: array<struct<ruleId: string, level: string, locations: array<struct<physicalLocation: struct<region: struct<startLine: int>>>>>>>>>"
    d = documents.withColumn("j", F.from_json("sarif", kind))
    runs, all_results = F.col("j.runs"), F.flatten(F.transform("j.runs", lambda r: F.coalesce(r["results"], F.array())))
    line_ok = lambda r: F.forall(F.coalesce(r["locations"], F.array()), lambda x: F.coalesce(x["physicalLocation"]["region"]["startLine"] >= 1, F.lit(True)))
    checks = F.array(
        F.when(F.coalesce(F.col("j.version"), F.lit("")) != "2.1.0", "version"),
        F.when(F.coalesce(F.size(runs), F.lit(0)) < 1, "no runs"),
        F.when(F.exists(runs, lambda r: r["results"].isNull()), "null results"),
        F.when(F.exists(all_results, lambda r: empty(r["ruleId"]) == ""), "ruleId"),
        F.when(F.exists(all_results, lambda r: ~empty(r["level"]).isin("error", "warning", "note", "none")), "level"),
        F.when(F.exists(all_results, lambda r: ~line_ok(r)), "startLine"),
    )
    return d.select("run", F.explode(F.array_compact(checks)).alias("violation"))
