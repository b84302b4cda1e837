"""Policy scoring of findings, thresholds, gates and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import empty, strip_ws

KEY = ("owner", "repo", "pr")
# Severities by rank.
RANK = {"SUPPRESS": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
# Category -> (impact, confidence floor, severity by raw label).
POLICY = {
    "security.hardcoded-secret": (0.95, 0.90, {"critical": "CRITICAL", "high": "CRITICAL", "medium": "HIGH", "low": "HIGH", "default": "CRITICAL"}),
    "security.missing-auth": (0.90, 0.85, {"default": "HIGH"}),
    "bug.missing-error-wrap": (0.50, 0.65, {"default": "MEDIUM"}),
    "maintainability.naming": (0.10, 0.60, {"default": "SUPPRESS"}),
    "secret": (0.95, 0.90, {"critical": "CRITICAL", "high": "CRITICAL", "medium": "HIGH", "low": "HIGH", "info": "MEDIUM", "default": "CRITICAL"}),
    "sast": (0.70, 0.75, {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "info": "LOW", "default": "MEDIUM"}),
    "cve": (0.80, 0.85, {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "info": "LOW", "default": "HIGH"}),
    "security": (0.85, 0.70, {"critical": "CRITICAL", "high": "HIGH", "medium": "HIGH", "low": "MEDIUM", "default": "HIGH"}),
    "bug": (0.55, 0.60, {"critical": "HIGH", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "default": "MEDIUM"}),
    "performance": (0.40, 0.55, {"critical": "HIGH", "high": "MEDIUM", "medium": "MEDIUM", "low": "LOW", "default": "LOW"}),
    "maintainability": (0.20, 0.55, {"critical": "MEDIUM", "high": "MEDIUM", "medium": "LOW", "low": "SUPPRESS", "default": "LOW"}),
    "test": (0.30, 0.55, {"critical": "MEDIUM", "high": "MEDIUM", "medium": "LOW", "low": "LOW", "default": "LOW"}),
    "style": (0.10, 0.50, {"default": "SUPPRESS"}),
    "documentation": (0.15, 0.50, {"medium": "LOW", "high": "LOW", "default": "SUPPRESS"}),
}
DEFAULTS = (0.40, 0.50, {"critical": "HIGH", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "default": "MEDIUM"})
# Categories of suggestions and of normalized findings.
SUGGESTION_CATEGORIES = ("style", "maintainability", "test", "documentation")
CATEGORIES = ("bug", "security", "performance", "maintainability", "test", "style", "documentation", "other")
SEVERITIES = ("critical", "high", "medium", "low")
BUMP = 0.05


def score(findings: DataFrame, policy: dict = POLICY, defaults: tuple = DEFAULTS) -> DataFrame:
    """JON-8: adds score_severity, confidence, impact, rationale.

    The policy entry is the exact category, else the part before the first dot, else the defaults.
    The policy is a map literal (a few dozen entries), so scoring needs no join at all.
    """
    entries = {**{k: v for k, v in policy.items() if v[2]}, "defaults": defaults}
    cat, raw = F.lower(strip_ws(empty(F.col("category")))), F.lower(strip_ws(empty(F.col("severity"))))
    keys = [k for k in entries if k != "defaults"]
    prefix = F.when(F.instr(cat, ".") > 1, F.substring_index(cat, ".", 1)).otherwise("")
    key = F.when(cat.isin(keys), cat).when(prefix.isin(keys), prefix).otherwise("defaults")
    flat = {f"{k}|{s}": v for k, (_, _, m) in entries.items() for s, v in m.items()}
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    severity, impact, floor = literal(flat), literal({k: float(v[0]) for k, v in entries.items()}), literal({k: float(v[1]) for k, v in entries.items()})
    out = findings.withColumn("rationale", key)
    r = F.col("rationale")
    bump = F.when(F.col("source").startswith("scanner:") | cat.contains("."), BUMP).otherwise(0.0)
    return (
        out.withColumn(
            "score_severity",
            F.coalesce(
                F.when(raw != "", F.try_element_at(severity, F.concat(r, F.lit("|"), raw))), F.try_element_at(severity, F.concat(r, F.lit("|default"))), F.lit("SUPPRESS")
            ),
        )
        .withColumn("confidence", F.least(F.try_element_at(floor, r) + bump, F.lit(1.0)))
        .withColumn("impact", F.try_element_at(impact, r))
    )


def rank(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), severity), F.lit(0))


def at_least(scored: DataFrame, least: str = "LOW") -> DataFrame:
    """FLT-8: suppressed findings always go, then those under ``least``."""
    return scored.where((F.col("score_severity") != "SUPPRESS") & (rank(F.col("score_severity")) >= RANK[least]))


def located(findings: DataFrame) -> DataFrame:
    """FLT-7: findings with a place."""
    return findings.where(~((F.col("start_line") == 0) & (F.col("end_line") == 0)))


def normalized(findings: DataFrame, default_path: str = "") -> DataFrame:
    """FLT-19: categories and severities are lower case and known ones; rows without path or content go."""
    clamp = lambda c, known, other: F.when(F.lower(strip_ws(empty(F.col(c)))).isin(*known), F.lower(strip_ws(empty(F.col(c))))).otherwise(other)
    path = F.when(strip_ws(empty(F.col("path"))) == "", F.lit(default_path)).otherwise(F.col("path"))
    return (
        findings.withColumn("category", clamp("category", CATEGORIES, "other"))
        .withColumn("severity", clamp("severity", SEVERITIES, "low"))
        .withColumn("path", path)
        .where((strip_ws(empty(F.col("path"))) != "") & (strip_ws(empty(F.col("content"))) != ""))
    )


def is_suggestion() -> Column:
    """FLT-9: low severity, a quality category and a suggested replacement."""
    low = lambda c: F.lower(strip_ws(empty(F.col(c))))
    return (low("severity") == "low") & low("category").isin(*SUGGESTION_CATEGORIES) & (strip_ws(empty(F.col("suggestion_code"))) != "")


def blocking(findings: DataFrame, suggestions_block: bool = False) -> DataFrame:
    """FLT-9: the findings that count for the gate: all but suggestions, or all."""
    return findings if suggestions_block else findings.where(~is_suggestion())


def is_nit() -> Column:
    return (F.col("severity") == "low") & F.col("category").isin(*SUGGESTION_CATEGORIES)


def first_by_location(findings: DataFrame) -> DataFrame:
    """WIN-1: the first finding of each place, model and scanner findings apart."""
    w = Window.partitionBy(*KEY, "path", "start_line", "end_line", F.col("source").startswith("scanner:")).orderBy("ord")
    return findings.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def severity_histogram(scored: DataFrame, *by: str) -> DataFrame:
    """AGG-3: zero-filled counts of the four severities."""
    sums = [F.count_if(F.col("score_severity") == s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    return scored.groupBy(*(by or KEY)).agg(*sums)


def risk_label(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-12: the labelled risk, raised to what scores and scanners show, never lowered.

    ``labels``: key and risk_tag. Every labelled change set gets a row.
    """
    tags = ("", "risk/low", "risk/medium", "risk/high", "risk/critical")
    raw = F.upper(strip_ws(empty(F.col("severity"))))
    scanner = F.when(~F.col("source").startswith("scanner:"), 0).when(raw == "CRITICAL", 4).when(raw.isin("HIGH", "ERROR"), 3).otherwise(0)
    own = F.when(F.col("score_severity") == "CRITICAL", 4).when(F.col("score_severity") == "HIGH", 3).otherwise(0)
    target = scored.groupBy(*KEY).agg(F.max(F.greatest(own, scanner)).alias("target"))
    current = F.greatest(F.array_position(F.array(*[F.lit(t) for t in tags]), F.lower(strip_ws(empty(F.col("risk_tag"))))) - 1, F.lit(0))
    out = labels.join(target, list(KEY), "left").withColumn("target", F.coalesce("target", F.lit(0)))
    raised = F.element_at(F.array(*[F.lit(t) for t in tags]), (F.col("target") + 1).cast("int"))
    return out.select(*KEY, F.when(F.col("target") > current, raised).otherwise(F.col("risk_tag")).alias("risk_tag"))


def blocker_gate(scored: DataFrame, suggestions_block: bool = False) -> DataFrame:
    """AGG-13: exit code 3 for change sets with a critical finding that counts, else 0.

    ``scored`` may hold null score_severity for unscored findings: their raw label decides.
    """
    counts = F.lit(True) if suggestions_block else ~is_suggestion()
    hit = F.when(F.col("score_severity").isNotNull(), F.col("score_severity") == "CRITICAL").otherwise(F.col("severity").isin("critical", "blocker"))
    return scored.groupBy(*KEY).agg(F.when(F.bool_or(counts & hit), 3).otherwise(0).alias("exit_code"))


def comment_body(fingerprint: Column | None = None, marker: str = "<!-- review:fp:") -> Column:
    """SNK-4: the comment text of a finding, with a suggestion block and a hidden fingerprint."""
    sev, cat, code = empty(F.col("severity")), empty(F.col("category")), empty(F.col("suggestion_code"))
    block = (code != "") & (empty(F.col("existing_code")) != "") & ~code.contains("```")
    parts = [
        F.when(is_nit(), "**[nit]** ").otherwise(""),
        F.when((sev != "") | (cat != ""), F.concat(F.lit("**["), sev, F.lit(" / "), cat, F.lit("]** "))).otherwise(""),
        strip_ws(empty(F.col("content"))),
        F.when(block, F.concat(F.lit("\n\n```suggestion\n"), code, F.when(code.endswith("\n"), "").otherwise("\n"), F.lit("```"))).otherwise(""),
    ]
    if fingerprint is not None:
        parts.append(F.when(empty(fingerprint) != "", F.concat(F.lit(f"\n\n{marker}"), fingerprint, F.lit(" -->"))).otherwise(""))
    return F.concat(*parts)


def marked_fingerprint(body: Column, marker: str = "<!-- review:fp:") -> Column:
    """SRC-10: the fingerprint in a posted comment; '' if there is none."""
    return strip_ws(F.regexp_extract(empty(body), rf"(?s)\Q{marker}\E(.*?) -->", 1))


def is_unmarked_comment(body: Column, marker: str = "<!-- review:fp:") -> Column:
    """SRC-10: whether a comment without a marker begins like a rendered finding: '**[X / Y]** ' within its first 80 bytes."""
    b = strip_ws(empty(body))
    head = F.regexp_extract(b, r"(?s)^(\*\*\[.*?)\]\*\* ", 1)
    return ~empty(body).contains(marker) & (head != "") & (F.octet_length(head) <= 80) & head.contains(" / ")


def grouped_by_path(findings: DataFrame) -> DataFrame:
    """AGG-10: findings of a path as one ordered array."""
    item = F.struct("ord", "category", "severity", "start_line", "end_line", "content")
    return findings.groupBy(*KEY, "path").agg(F.array_sort(F.collect_list(item)).alias("findings"), F.count("*").alias("n"))


def scanner_tally(findings: DataFrame, tools: tuple[str, ...] = ("gitleaks", "semgrep", "govulncheck"), change_sets: DataFrame | None = None) -> DataFrame:
    """AGG-9: findings by known tool, zero-filled, one row a change set.

    Change sets without findings get a row if ``change_sets`` (key) names them.
    """
    if change_sets is not None:
        keys = change_sets.select(*KEY).distinct()
        findings = findings.select(*KEY, "source").unionByName(keys.withColumn("source", F.lit("")))
    return findings.groupBy(*KEY).agg(*[F.count_if(F.col("source") == f"scanner:{t}").alias(f"n_{t}") for t in tools])


def drop_nth(findings: DataFrame, removals: DataFrame) -> DataFrame:
    """WIN-7: without the n-th finding (from 0) of a path; ``removals``: key, path, n."""
    w = Window.partitionBy(*KEY, "path").orderBy("ord")
    return findings.withColumn("n", F.row_number().over(w) - 1).join(removals, [*KEY, "path", "n"], "left_anti").drop("n")
