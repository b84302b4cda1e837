"""Reviewer effort of change sets, with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import KEY, severity_histogram
from tidemark.operators.selection import touches_auth, touches_infra, touches_migration

# Points and caps of each signal.
POLICY = {
    "base": 0.5, "loc": (0.05, 2.5), "files": (0.05, 1.5), "new": (0.10, 1.5), "largest": (0.03, 1.0), "test25": -0.5, "test50": -1.0,
    "auth": 1.5, "migration": 1.5, "infra": 1.0, "overlap": (0.5, 1.5), "critical": 1.5, "high": 0.75, "medium": 0.30, "low": 0.05, "findings": 4.0,
}


def effort_severities(scored: DataFrame, count_by: str = "key") -> DataFrame:
    """AGG-5, findings: key, n_critical .. n_low of scored findings (path, start_line, end_line, content, score_severity, ord).

    By ``key``, findings of one place whose content begins with the same 64 bytes are one, with the severity
    of the last; by ``row``, each counts.
    """
    if count_by not in ("key", "row"):
        raise ValueError(f"count_by is 'key' or 'row', not {count_by!r}")
    if count_by == "key":
        head = F.substring(F.encode(F.coalesce("content", F.lit("")), "utf-8"), 1, 64).alias("head")
        scored = scored.groupBy(*KEY, "path", "start_line", "end_line", head).agg(F.max_by("score_severity", "ord").alias("score_severity"))
    return severity_histogram(scored)


def effort_scores(files: DataFrame, severities: DataFrame | None = None, overlaps: DataFrame | None = None, policy: dict = POLICY) -> DataFrame:
    """AGG-5: key, value (0-10), label, raw, contributions (signal, detail, points, capped).

    ``files``: key, path, ord, lines_added, lines_deleted, is_new, is_renamed, is_test.
    ``severities``: key, n_critical .. n_low. ``overlaps``: key, n_overlapping. One aggregation by
    change set; everything after it is arithmetic on its row.
    """
    path = F.col("path")
    lines = F.col("lines_added") + F.col("lines_deleted")
    first = lambda c: F.min(F.when(c, F.struct("ord", "path")))["path"]
    aggs = [
        F.sum("lines_added").alias("added"), F.sum("lines_deleted").alias("deleted"), F.count("*").alias("n"),
        F.count_if(F.col("is_new") & ~F.col("is_renamed")).alias("fresh"), F.max(lines).alias("top"),
        F.max_by("path", F.struct(lines, -F.col("ord"))).alias("top_path"), F.count_if("is_test").alias("tests"),
    ]
    for name, c in (("auth", touches_auth(path)), ("migration", touches_migration(path)), ("infra", touches_infra(path))):
        aggs += [F.count_if(c).alias(f"n_{name}"), first(c).alias(f"p_{name}")]
    g = files.groupBy(*KEY).agg(*aggs)
    sev = ("critical", "high", "medium", "low")
    if severities is not None:
        g = g.join(severities.select(*KEY, *[f"n_{s}" for s in sev]), list(KEY), "left")
    for s in sev:
        g = g.withColumn(f"n_{s}", F.coalesce(F.col(f"n_{s}") if severities is not None else F.lit(0), F.lit(0)))
    g = g.join(overlaps.select(*KEY, "n_overlapping"), list(KEY), "left") if overlaps is not None else g.withColumn("n_overlapping", F.lit(0))
    g = g.withColumn("n_overlapping", F.coalesce("n_overlapping", F.lit(0)))

    def item(signal: str, detail: Column, raw: Column, cap: float | None, on: Column) -> Column:
        capped = (raw >= cap) if cap else F.lit(False)
        points = F.when(capped, F.lit(float(cap or 0))).otherwise(raw)
        return F.when(on, F.struct(F.lit(signal).alias("signal"), detail.alias("detail"), points.cast("double").alias("points"), capped.alias("capped")))

    c, text = F.col, lambda f, *cols: F.format_string(f, *cols)
    churn = c("added") + c("deleted")
    per = lambda n, k: n.cast("double") / 10.0 * policy[k][0]
    ratio = c("tests") / c("n")
    bonus = F.when(ratio >= 0.5, policy["test50"]).when(ratio >= 0.25, policy["test25"]).otherwise(0.0)
    found = sum((c(f"n_{s}") * policy[s] for s in sev), F.lit(0.0))
    hit = lambda k: F.when(c(f"n_{k}") > 1, text("%s (+%d more)", c(f"p_{k}"), c(f"n_{k}") - 1)).otherwise(c(f"p_{k}"))
    items = F.array(
        item("Base", F.lit(""), F.lit(policy["base"]), None, F.lit(True)),
        item("LOC churn", text("+%d / −%d (%d lines)", c("added"), c("deleted"), churn), per(churn, "loc"), policy["loc"][1], churn > 0),
        item("Files changed", text("%d file(s)", c("n")), c("n") * policy["files"][0], policy["files"][1], c("n") > 0),
        item("New files", text("%d new", c("fresh")), c("fresh") * policy["new"][0], policy["new"][1], c("fresh") > 0),
        item("Largest single file", text("%d lines in %s", c("top"), c("top_path")), per(c("top"), "largest"), policy["largest"][1], c("top") > 0),
        item("Test file ratio", text("%.0f%% (%d test / %d total)", ratio * 100, c("tests"), c("n")), bonus, None, c("tests") < c("n")),
        *[item(f"{k.capitalize()} path touched", hit(k), F.lit(policy[k]), None, c(f"n_{k}") > 0) for k in ("auth", "migration", "infra")],
        item("Overlapping PRs", text("%d other PR(s)", c("n_overlapping")), c("n_overlapping") * policy["overlap"][0], policy["overlap"][1], c("n_overlapping") > 0),
        item("Findings", text("%d CRIT / %d HIGH / %d MED / %d LOW", *[c(f"n_{s}") for s in sev]), found, policy["findings"], found > 0),
    )
    kept = F.filter(items, lambda x: x.isNotNull() & ((x["points"] != 0) | x["capped"]))
    raw = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["points"])
    v = F.col("value")
    return (
        g.withColumn("contributions", kept)
        .withColumn("raw", F.least(F.lit(10.0), F.greatest(F.lit(0.0), raw)))
        .withColumn("value", F.round("raw").cast("int"))
        .withColumn("label", F.when(v <= 2, "trivial").when(v <= 4, "light").when(v <= 6, "medium").when(v <= 8, "medium-high").otherwise("heavy"))
        .select(*KEY, "value", "label", "raw", "contributions")
    )
