"""Identity of findings across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import byte_prefix, empty, fingerprint, line_symbol, strip_ws
from tidemark.operators.scoring import KEY


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """FUN-1: adds the fingerprint; a column ``symbol`` replaces the line range if there is one."""
    symbol = F.col("symbol") if "symbol" in findings.columns else line_symbol(F.col("start_line"), F.col("end_line"))
    return findings.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("owner", "repo", "category", "path")], symbol, F.col("existing_code")))


def reconcile(previous: DataFrame, fresh: DataFrame, changed: DataFrame, include_resolved: bool = False) -> DataFrame:
    """JON-1: state of every finding after a run: keep, new or carried (and resolved, on request).

    ``previous``: key, fingerprint, path, ord, first_seen. ``fresh``: key, fingerprint, path, ord,
    seen. ``changed``: key, path. A fresh finding that was known is 'keep' and keeps its
    first_seen, else 'new'. A previous one that is gone is 'carried' where its path didn't change,
    else 'resolved'. Lookups take the last row of a fingerprint; driving rows are all kept, so
    repeated rows never multiply.
    """
    keys = [*KEY, "fingerprint"]
    last = previous.groupBy(*keys).agg(F.max_by("first_seen", "ord").alias("was"), F.lit(True).alias("known"))
    now = fresh.groupBy(*KEY).agg(F.max("seen").alias("now"))
    current = fresh.join(last, keys, "left").select(
        *keys, "path", "ord", F.when(F.col("known"), "keep").otherwise("new").alias("state"),
        F.coalesce("was", "seen").alias("first_seen"), F.col("seen").alias("last_seen"),
    )
    gone = previous.join(fresh.select(*keys).distinct(), keys, "left_anti")
    touched = changed.select(*KEY, "path").distinct().withColumn("touched", F.lit(True))
    gone = gone.join(touched, [*KEY, "path"], "left").join(now, list(KEY), "left")
    gone = gone.select(
        *keys, "path", "ord", F.when(F.col("touched"), "resolved").otherwise("carried").alias("state"),
        "first_seen", F.when(F.col("touched"), F.col("first_seen")).otherwise(F.coalesce("now", "first_seen")).alias("last_seen"),
    )
    if not include_resolved:
        gone = gone.where("state = 'carried'")
    return current.unionByName(gone)


def reconcile_runs(findings: DataFrame, previous: int, fresh: int, changed: DataFrame, include_resolved: bool = False) -> DataFrame:
    """JON-1 for two runs of one table: key, fingerprint, path, ord, state, first_seen, last_seen.

    ``findings``: key, run_id, fingerprint, path, ord. A fingerprint is one finding of its run: the
    greatest path and ord of its rows count. Both runs meet in one aggregation by key and
    fingerprint (combined before the shuffle, so repeated findings cost nothing). The latest ord of
    the fresh run is a second aggregate over two narrow columns, without fingerprints, and one join
    says which paths changed.
    """
    of = lambda f, run, c: f(F.when(F.col("run_id") == run, F.col(c)))
    both = findings.where(F.col("run_id").isin(previous, fresh)).groupBy(*KEY, "fingerprint").agg(
        of(F.max, previous, "path").alias("was_path"), of(F.max, previous, "ord").alias("was"), of(F.max, fresh, "path").alias("new_path"), of(F.max, fresh, "ord").alias("new"),
    )
    now = findings.where(F.col("run_id") == fresh).groupBy(*KEY).agg(F.max("ord").alias("now"))
    touched = changed.select(*KEY, F.col("path").alias("was_path")).distinct().withColumn("touched", F.lit(True))
    d = both.join(touched.hint("merge"), [*KEY, "was_path"], "left").join(now.hint("merge"), list(KEY))
    gone = F.col("new").isNull()
    state = F.when(gone, F.when(F.col("touched"), "resolved").otherwise("carried")).when(F.col("was").isNull(), "new").otherwise("keep")
    last = F.when(~gone, F.col("new")).when(F.col("touched"), F.col("was")).otherwise(F.coalesce("now", "was"))
    out = d.select(
        *KEY, "fingerprint", F.when(gone, F.col("was_path")).otherwise(F.col("new_path")).alias("path"), F.coalesce("new", "was").alias("ord"), state.alias("state"),
        F.coalesce("was", "new").alias("first_seen"), last.alias("last_seen"),
    )
    return out if include_resolved else out.where("state <> 'resolved'")


def reconcile_pushes(previous: DataFrame, pushes: DataFrame) -> DataFrame:
    """JON-1 over any number of pushes of each change set, one after the other: the state after the last.

    ``previous``: key, fingerprint, path, ord, first_seen, last_seen, push (the last one that it
    contains). ``pushes``: key, push (their order), fingerprint, path, ord, seen; a row without a fingerprint says that
    the push changed its path and found nothing there, or nothing at all where the path is null too. Paths
    of a push's rows count as changed. Change sets without a push aren't returned.

    A finding's life is told by its pushes alone, so nothing is folded in a loop: it lives from one
    presence to the next unless a push between them changed its path; it is in the state if its last life
    reaches the last push. A presence is compared with the next change of its path (a window by path) and with its
    next presence (a window by fingerprint); the groups are as large as the pushes that name them.
    """
    found = [*KEY, "fingerprint"]
    last = pushes.groupBy(*KEY).agg(F.max("push").alias("last_push"), F.max_by("seen", F.struct("push", "seen")).alias("now"))
    mine = previous.join(last.select(*KEY).hint("merge"), list(KEY), "left_semi")
    rows = mine.select(*found, "path", "ord", "push", F.col("first_seen").alias("seen"), F.lit(True).alias("known")).unionByName(
        pushes.where("fingerprint is not null").select(*found, "path", "ord", "push", "seen", F.lit(False).alias("known"))
    )
    once = rows.groupBy(*found, "path", "push").agg(F.max_by("seen", "ord").alias("seen"), F.max("known").alias("known"))
    touches = pushes.where("path is not null").select(*KEY, "path", "push").distinct().withColumn("touch", F.col("push"))
    later = Window.partitionBy(*KEY, "path").orderBy(F.desc("push")).rangeBetween(Window.unboundedPreceding, -1)
    marked = once.withColumn("touch", F.lit(None).cast("long")).unionByName(touches, allowMissingColumns=True)
    marked = marked.withColumn("next_touch", F.min("touch").over(later)).where("fingerprint is not null")
    life = Window.partitionBy(*found).orderBy("push", "path")
    marked = marked.withColumn("next", F.lead("push").over(life))
    marked = marked.withColumn("ends", F.coalesce(F.col("next_touch") < F.col("next"), F.col("next_touch").isNotNull() & F.col("next").isNull(), F.lit(False)))
    marked = marked.withColumn("lives", F.coalesce(F.sum(F.col("ends").cast("int")).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    born = Window.partitionBy(*found, "lives").orderBy("push", "path")
    marked = marked.withColumn("first_seen", F.first("seen").over(born)).withColumn("nth", F.row_number().over(born))
    alive = marked.where("next is null and not ends").select(*found, "path", "push", "first_seen", ((F.col("nth") > 1) | F.col("known")).alias("was"))
    out = rows.join(alive.hint("merge"), [*found, "path", "push"]).join(last.hint("merge"), list(KEY))
    here = F.col("push") == F.col("last_push")
    state = F.when(~here, "carried").when(F.col("was"), "keep").otherwise("new")
    return out.select(*found, "path", "ord", state.alias("state"), "first_seen", F.when(here, F.col("seen")).otherwise(F.col("now")).alias("last_seen"), F.col("last_push").alias("push"))


def carryover_counts(states: DataFrame) -> DataFrame:
    """AGG-1: kept, new, carried and resolved by change set (from reconcile with include_resolved)."""
    names = {"keep": "kept", "new": "new", "carried": "carried", "resolved": "resolved"}
    return states.groupBy(*KEY).agg(*[F.count_if(F.col("state") == k).alias(f"n_{v}") for k, v in names.items()])


def in_changed_paths(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """JON-2: scanner findings of changed, reviewable paths."""
    skip = F.lower("path").rlike(r"(^|/)(\.claude|vendor|node_modules)/")
    return findings.where(~skip).join(changed.select(*KEY, "path").distinct(), [*KEY, "path"], "left_semi")


def unified(model: DataFrame, scanner: DataFrame) -> DataFrame:
    """SET-1: scanner findings mapped to model findings and appended.

    ``scanner``: key, ord, tool, path, line, severity, description, evidence.
    """
    text = F.when(F.col("description") == "", F.concat("tool", F.lit(" finding"))).otherwise(F.col("description"))
    text = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(text, F.lit("\n\n"), "evidence")).otherwise(text)
    line = F.greatest("line", F.lit(1))
    mapped = scanner.select(
        *KEY, "ord", "path", F.lit("security").alias("category"), F.lower("severity").alias("severity"), F.concat(F.lit("scanner:"), "tool").alias("source"),
        line.alias("start_line"), line.alias("end_line"), text.alias("content"),
    )
    return model.select(*mapped.columns).unionByName(mapped)


def scanner_table(findings: DataFrame, *by: str) -> DataFrame:
    """FUN-14: a Markdown table of the scanner findings of each group, in order of ``ord``; groups without any give no row.

    White space is collapsed; a text of more than 100 bytes is cut to 97 and an ellipsis.
    """
    flat = strip_ws(F.regexp_replace(empty(F.col("content")), r"\s+", " "))
    text = F.when(F.octet_length(flat) > 100, F.concat(byte_prefix(flat, 97), F.lit("..."))).otherwise(flat)
    rule = F.when(empty(F.col("category")) == "", "-").otherwise(F.col("category"))
    cells = [F.expr("substring(source, 9)"), rule, F.concat(F.lit("`"), empty(F.col("path")), F.lit(":"), F.col("start_line").cast("string"), F.lit("`")), text]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))
    rows = findings.where(F.col("source").startswith("scanner:")).select(*by, "ord", row.alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "row"))), lambda x: x["row"]), "")
    return rows.groupBy(*by).agg(F.concat(F.lit("| Tool | Rule | Location | Finding |\n| --- | --- | --- | --- |\n"), body).alias("table"))
