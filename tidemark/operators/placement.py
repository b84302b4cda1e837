"""Where a finding's quoted code is in a change, by an index of runs of normalized lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_ws
from tidemark.operators.scoring import KEY
from tidemark.sources.shared import written

def normalized_line(c: Column) -> Column:
    """A line without the space around it and without one '+' and then one '-' before it."""
    return strip_ws(F.regexp_replace(strip_ws(c), r"^\+?-?", ""))


def _doubled(hashes: str, span: int) -> Column:
    """Hashes of runs of twice as many lines as those in the column ``hashes``, which are of ``span`` lines each."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - span, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + span)))


def run_hashes(rows: DataFrame, hashes: str, levels: int) -> DataFrame:
    """Adds ``runs``: for each level k up to ``levels`` an array, by position, of the hash of the 2^k lines from there."""
    d = rows.withColumn("_run_0", F.col(hashes))
    for k in range(levels):
        d = d.withColumn(f"_run_{k + 1}", _doubled(f"_run_{k}", 1 << k))
    names = [f"_run_{k}" for k in range(levels + 1)]
    return d.withColumn("runs", F.array(*names)).drop(*names)


def side_lines(hunks: DataFrame, contents: DataFrame) -> DataFrame:
    """key, change_id, stage, hunk_no, numbers, hashes: what findings may be placed on, the lines of a side in order.

    Stage 1 is the new side of each hunk, 2 the old side, 3 the new file without blank lines.
    ``hunks``: key, change_id, hunk_no, pos, type, content, old_line, new_line; ``contents``: key,
    change_id, content. Each table is read once.
    """
    ident = [*KEY, "change_id"]
    line = F.struct(F.lit(1).alias("stage"), F.col("new_line").cast("long").alias("no")), F.struct(F.lit(2).alias("stage"), F.col("old_line").cast("long").alias("no"))
    on = F.filter(F.array(F.when(F.col("type") != "deleted", line[0]), F.when(F.col("type") != "added", line[1])), lambda x: x.isNotNull())
    own = hunks.select(*ident, "hunk_no", F.xxhash64(normalized_line(F.col("content"))).alias("h"), F.explode_outer(on).alias("s")).where("s is not null")
    own = own.groupBy(*ident, F.col("s.stage").alias("stage"), "hunk_no").agg(F.sort_array(F.collect_list(F.struct("s.no", "h"))).alias("l"))
    text = F.transform(F.split("content", "\n"), lambda x, k: F.struct((k + 1).cast("long").alias("no"), normalized_line(x).alias("line")))
    full = F.transform(F.filter(text, lambda x: x["line"] != ""), lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["line"]).alias("h")))
    whole = contents.select(*ident, F.lit(3).alias("stage"), F.lit(0).alias("hunk_no"), full.alias("l"))
    every = own.unionByName(whole).where("l is not null")
    return every.select(*ident, "stage", "hunk_no", F.transform("l", lambda x: x["no"]).alias("numbers"), F.transform("l", lambda x: x["h"]).alias("hashes"))


def _open(findings: DataFrame) -> DataFrame:
    """Findings without a place that quote code: finding_id, key, m (its lines), hashes (of them)."""
    lines = F.filter(F.transform(F.split("existing_code", "\n"), normalized_line), lambda x: x != "")
    found = findings.where("start_line <= 0 and end_line <= 0").select("finding_id", *KEY, F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"))
    return found.withColumn("m", F.size("hashes")).where("m > 0")


def matches_of(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """finding_id, change_id, stage, start, end: the first run of a finding's lines in each change of its change set.

    An index has the hashes of runs of 1, 2, 4, ... lines at each position, for the lengths that findings
    need; it is written once. A run of m lines is the run of the largest such length that fits at its start and the
    one at its end, which overlap: two equality lookups, however long the quote is. Lines are compared by
    64-bit hashes.
    """
    todo = written(_open(findings), "quotes")
    longest = todo.agg(F.max("m")).first()[0] or 1
    levels = longest.bit_length() - 1
    level = F.floor(F.log2("m") + 1e-9).cast("int")
    asked = run_hashes(todo, "hashes", levels).withColumn("level", level).withColumn("shift", F.col("m") - F.expr("shiftleft(1, level)"))
    own = F.get("runs", F.col("level"))
    asked = asked.select("finding_id", *KEY, "level", "shift", F.get(own, F.lit(0)).alias("hash"), F.get(own, F.col("shift")).alias("tail"))
    asked = written(asked, "quote-runs")
    used = [r.level for r in asked.select("level").distinct().collect()]  # about 2 log of the longest quote at most
    ident = ["change_id", "stage", "hunk_no"]
    runs = run_hashes(lines, "hashes", levels).select(*KEY, *ident, "numbers", F.posexplode_outer("runs").alias("level", "run")).where(F.col("level").isin(used))
    runs = runs.select(*KEY, *ident, "level", "numbers", F.posexplode_outer("run").alias("pos", "hash")).where("pos is not null")
    index = written(
        runs.select(*KEY, *ident, "level", "hash", "pos", F.get("numbers", F.col("pos")).alias("first"), F.get("numbers", F.col("pos") + F.expr("shiftleft(1, level)") - 1).alias("last")),
        "runs",
    )
    heads = asked.join(index.hint("merge"), [*KEY, "level", "hash"])
    whole = heads.where("shift = 0").select("finding_id", *ident, "pos", F.col("first").alias("start"), F.col("last").alias("end"))
    split = heads.where("shift > 0").select("finding_id", *KEY, *ident, "level", F.col("tail").alias("hash"), "pos", F.col("first").alias("start"), (F.col("pos") + F.col("shift")).alias("at"))
    ends = index.select(*KEY, *ident, "level", "hash", F.col("pos").alias("at"), F.col("last").alias("end"))
    split = split.join(ends.hint("merge"), [*KEY, *ident, "level", "hash", "at"]).select("finding_id", *ident, "pos", "start", "end")
    first = F.min(F.struct("stage", "hunk_no", "pos", "start", "end")).alias("p")
    return whole.unionByName(split).groupBy("finding_id", "change_id").agg(first).select("finding_id", "change_id", "p.stage", "p.start", "p.end")


def placed(findings: DataFrame, changes: DataFrame, lines: DataFrame) -> DataFrame:
    """JON-12, JON-13: findings with path, start_line and end_line where their quoted code is.

    A finding that has a line, or quotes nothing, stays. Otherwise the change of its path (the
    latest by ``ord`` that has it as new or old path) is looked through; where that fails, a finding
    whose code occurs in exactly one other file of the change set moves there. ``placed_by`` is
    'given', 'own', 'moved' or 'none'. ``changes``: key, change_id, old_path, new_path, ord.
    """
    hits = matches_of(findings, lines)
    of = changes.select(*KEY, "change_id", "ord", F.explode(F.array_distinct(F.array("new_path", "old_path"))).alias("path"))
    of = of.where("path is not null and path not in ('', '/dev/null')").groupBy(*KEY, "path").agg(F.max_by("change_id", "ord").alias("own_id"))
    names = changes.select("change_id", "new_path", "old_path")
    who = findings.select("finding_id", *KEY, "path").join(of.hint("merge"), [*KEY, "path"], "left").select("finding_id", "path", "own_id")
    d = written(hits, "placements").join(who.hint("merge"), "finding_id").join(names.hint("merge"), "change_id")
    is_own = F.coalesce(F.col("change_id") == F.col("own_id"), F.lit(False))
    other = ~F.coalesce(F.col("new_path") == F.col("path"), F.lit(False)) & ~F.coalesce(F.col("old_path") == F.col("path"), F.lit(False))
    to = F.coalesce(F.nullif("new_path", F.lit("")), "old_path")
    best = d.groupBy("finding_id").agg(
        F.max(F.when(is_own, F.struct(F.col("path").alias("path"), "start", "end"))).alias("own"),
        F.count_if(other).alias("n"),
        F.max(F.when(other, F.struct(to.alias("path"), "start", "end"))).alias("away"),
    )
    moved = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("n") == 1, F.col("away"))
    best = best.select("finding_id", moved.alias("to"), F.when(F.col("own").isNotNull(), "own").when(F.col("n") == 1, "moved").alias("how"))
    given = (F.col("start_line") > 0) | (F.col("end_line") > 0)
    out = findings.join(best.hint("merge"), "finding_id", "left")
    for c, field in (("path", "path"), ("start_line", "start"), ("end_line", "end")):
        out = out.withColumn(c, F.coalesce(F.col(f"to.{field}"), F.col(c)))
    return out.withColumn("placed_by", F.coalesce("how", F.when(given, "given").otherwise("none"))).drop("to", "how")
