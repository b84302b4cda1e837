"""Unified diffs as tables of files and numbered lines.

A diff is one row and is cut within it: nothing is shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that are numbered together: an array that grows line by line is copied each time, so it is kept short.
CHUNK = 64


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _cut(lines: Column, begins: Callable[[Column], Column]) -> Column:
    """Array of struct(at, lines): the sections that begin with a marked line; ``at`` is the place of that line. What is before the first goes."""
    marks = lambda x: F.filter(F.transform(x, lambda v, k: F.when(begins(v), k)), lambda k: k.isNotNull())

    def parts(x: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(x))
        return F.transform(at, lambda a, k: F.struct(a.alias("at"), F.slice(x, a + 1, end(k) - a).alias("lines")))

    return _with(lines, lambda x: _with(marks(x), lambda at: parts(x, at)))


def _files(diffs: DataFrame) -> DataFrame:
    """diff_id, file_no (from 1), at (place of its header), head (lines before its first hunk), hunks (array of at, lines)."""
    header = lambda v: v.rlike("^diff --git a/.+ b/.+$")
    d = diffs.select("diff_id", F.posexplode_outer(_cut(F.split("text", "\n"), header)).alias("k", "s")).where("k is not null")
    d = d.select("diff_id", (F.col("k") + 1).cast("bigint").alias("file_no"), F.col("s.at").alias("at"), F.col("s.lines").alias("lines"))
    d = d.withColumn("hunks", _cut(F.col("lines"), lambda v: v.rlike(r"^@@ -\d")))
    first = F.coalesce(F.get("hunks", 0)["at"], F.size("lines"))
    return d.select("diff_id", "file_no", "at", F.slice("lines", F.lit(1), first).alias("head"), "hunks")


def file_changes(diffs: DataFrame) -> DataFrame:
    """SRC-1: one row a file of each diff (``diff_id``, ``text``).

    Paths come from the header; 'rename from/to' override them. Added and deleted lines count
    inside hunks only, so a line like '+++i' counts there. The text keeps all but index lines.
    """
    has = lambda f: F.exists("head", f)
    found = lambda rx: F.array_max(F.transform(F.filter("head", lambda v: v.rlike(rx)), lambda v: F.regexp_extract(v, rx, 1)))
    body = F.flatten(F.col("hunks.lines"))
    count = lambda sign: F.aggregate("hunks", F.lit(0).cast("bigint"), lambda n, h: n + F.size(F.filter(h["lines"], lambda v: v.startswith(sign))))
    rename_from, rename_to = found(r"^rename from (.+)$"), found(r"^rename to (.+)$")
    return _files(diffs).select(
        "diff_id", "file_no", F.coalesce(rename_from, found(r"^diff --git a/(.+?) b/.+$")).alias("old_path"),
        F.when(has(lambda v: v.startswith("deleted file mode")), "/dev/null").otherwise(F.coalesce(rename_to, found(r"^diff --git a/.+? b/(.+)$"))).alias("new_path"),
        F.array_join(F.concat(F.filter("head", lambda v: ~v.startswith("index ")), body), "\n").alias("diff"),
        has(lambda v: v.startswith("new file mode")).alias("is_new"), has(lambda v: v.startswith("deleted file mode")).alias("is_deleted"),
        has(lambda v: v.rlike("^(Binary files .* differ|GIT binary patch)")).alias("is_binary"), rename_from.isNotNull().alias("is_renamed"),
        count("+").alias("insertions"), count("-").alias("deletions"),
    )


_HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
_ROW = "struct<pos:int,type:string,line:string,old:int,new:int>"


def _numbered(lines: Column, at: Column, old: Column, new: Column) -> Column:
    """Array of the lines behind a hunk's header with their place, type and numbers, in chunks with running numbers."""
    kind = lambda v: F.when(v.startswith("+"), "added").when(v.startswith("-"), "deleted").otherwise("context")
    state = lambda old, new, rows: F.struct(old.alias("old"), new.alias("new"), rows.alias("rows"))
    none = F.array().cast(f"array<{_ROW}>")

    def one(s: Column, v: Column) -> Column:
        was, now = v["type"] != "added", v["type"] != "deleted"
        row = F.struct(v["pos"].alias("pos"), v["type"].alias("type"), v["line"].alias("line"), F.when(was, s["old"]).alias("old"), F.when(now, s["new"]).alias("new"))
        return state(s["old"] + was.cast("int"), s["new"] + now.cast("int"), F.concat(s["rows"], F.array(row)))

    def chunk(s: Column, part: Column) -> Column:
        done = lambda t: state(t["old"], t["new"], F.concat(s["rows"], F.array(t["rows"])))
        return F.aggregate(part, state(s["old"], s["new"], none), one, done)

    told = F.transform(lines, lambda v, k: F.struct((at + k).alias("pos"), kind(v).alias("type"), v.alias("line")))
    told = F.filter(told, lambda v: (v["pos"] > at) & ~v["line"].startswith("\\ "))
    parts = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(CHUNK)), lambda k: F.slice(x, k, F.lit(CHUNK)))
    return _with(told, lambda x: F.flatten(F.aggregate(parts(x), state(old, new, F.array().cast(f"array<array<{_ROW}>>")), chunk, lambda s: s["rows"])))


def hunk_lines(diffs: DataFrame) -> DataFrame:
    """SRC-2: diff_id, file_no, hunk_no, pos, type, content, old_line, new_line of every hunk line.

    What has no prefix is context; the note about a missing line feed is skipped. Numbers are
    running counts from the hunk header's starts.
    """
    d = _files(diffs).select("diff_id", "file_no", "at", F.posexplode_outer("hunks").alias("k", "h")).where("k is not null")
    d = d.select("diff_id", "file_no", (F.col("k") + 1).cast("bigint").alias("hunk_no"), (F.col("at") + F.col("h.at")).alias("at"), F.col("h.lines").alias("lines"))
    start = lambda k: F.when(F.get("lines", 0).rlike(_HUNK), F.regexp_extract(F.get("lines", 0), _HUNK, k).cast("int"))
    d = d.select("diff_id", "file_no", "hunk_no", F.explode_outer(_numbered(F.col("lines"), F.col("at"), start(1), start(2))).alias("r")).where("r is not null")
    line = F.col("r.line")
    content = F.when(line.rlike("^[-+ ]"), F.expr("substring(r.line, 2)")).otherwise(line)
    return d.select("diff_id", "file_no", "hunk_no", "r.pos", "r.type", content.alias("content"), F.col("r.old").alias("old_line"), F.col("r.new").alias("new_line"))
