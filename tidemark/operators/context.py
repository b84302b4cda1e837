"""What goes into a review's context: rules, labels, diffs by path, and items under a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.filetype import language
from tidemark.functions.globs import doublestar_regex
from tidemark.functions.text import empty, excerpt, extension, parent_dir, strip_ws
from tidemark.operators.scoring import KEY
from tidemark.operators.selection import matches
from tidemark.sources.shared import written

# Labels that name a change's type; a change has one of them.
PR_TYPES = ("feat", "fix", "refactor", "docs", "test", "chore", "perf", "ci", "security")


@dataclass(frozen=True)
class Rule:
    """A custom rule of scope 'global', 'repo' or 'path'; globs as in path selection."""

    rule_id: str
    scope: str
    enabled: bool = True
    repos: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def _touches(rule: Rule) -> Column:
    """Whether some path of the change set is included and not excluded."""
    include, exclude = [[p for p in x if p] for x in (rule.paths, rule.exclude)]
    if not include:
        return F.lit(False)
    hit = (F.col("path") != "") & matches(F.col("path"), include)
    if exclude:
        hit &= ~matches(F.col("path"), exclude)
    return F.coalesce(F.bool_or(hit), F.lit(False))


def selected_rules(changes: DataFrame, rules: Sequence[Rule], cap: int = 15) -> DataFrame:
    """JON-16, TOP-4: owner, repo, pr, rule_id, rank of the rules that apply to a change set.

    Global rules come first, then by id; at most ``cap`` stay. ``changes`` has a row a path; a null
    path stands for a change set without files. The rules are configuration, so each becomes one
    flag of a single aggregation: rows are combined before the only shuffle and nothing is joined.
    """
    used = [r for r in rules if r.enabled and r.scope in ("global", "repo", "path")]
    flags = changes.groupBy(*KEY).agg(F.count("*").alias("n"), *[_touches(r).alias(f"f{k}") for k, r in enumerate(used)])
    name = F.concat_ws("/", "owner", "repo")
    found = []
    for k, r in enumerate(used):
        ok = F.lit(True) if r.scope == "global" else F.col(f"f{k}")
        if r.scope == "repo":
            ok = name.isin(*r.repos) & (F.col(f"f{k}") if r.paths else F.lit(True)) if r.repos else F.lit(False)
        found.append(F.when(ok, F.struct(F.lit(r.scope != "global").alias("local"), F.lit(r.rule_id).alias("rule_id"))))
    if not found:
        return changes.select(*KEY, F.lit("").alias("rule_id"), F.lit(0).alias("rank")).where("false")
    first = F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, cap)
    return flags.select(*KEY, F.posexplode(first).alias("pos", "r")).select(*KEY, "r.rule_id", (F.col("pos") + 1).alias("rank"))


def _glob_key(glob: str) -> tuple[str, str]:
    """The folders before a glob's first wildcard and the extension after its last one: what a path must have to match."""
    special = re.compile(r"[*?\[\]{}\\\\,]")
    segments = glob.split("/")
    fixed = next((i for i, x in enumerate(segments) if special.search(x)), len(segments))
    end = special.split(segments[-1])[-1]
    return "/".join(segments[:fixed]), "." + end.rpartition(".")[2] if "." in end else ""


def selected_from_many(changes: DataFrame, rules: Sequence[Rule], cap: int = 15) -> DataFrame:
    """JON-16, TOP-4 for thousands of rules: the rows of :func:`selected_rules`, whose plan has a column for each.

    Globs are a table keyed by the folders before their first wildcard and the extension behind their last. A
    distinct path of the fleet meets the globs under its own folders and extension, each is verified by its pattern,
    and what a path is touched by is written once. Of the global rules, which all apply, the first ``cap`` by id matter.
    """
    spark = changes.sparkSession
    used = [(k, r) for k, r in enumerate(rules) if r.enabled and r.scope in ("global", "repo", "path")]
    pathed = [(k, r) for k, r in used if r.scope != "global" and any(r.paths)]
    globs = [(k, yes, *_glob_key(g), doublestar_regex(g)) for k, r in pathed for yes, x in ((True, r.paths), (False, r.exclude)) for g in x if g]
    table = spark.createDataFrame(globs, "k int, included boolean, prefix string, ext string, rx string")
    path = changes.select("path").where("path <> ''").distinct()
    segments = F.split("path", "/")
    prefixes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")))
    exts = F.array_distinct(F.array(F.lit(""), F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    keyed = path.select("path", F.explode_outer(prefixes).alias("prefix"), exts.alias("exts")).select("path", "prefix", F.explode_outer("exts").alias("ext"))
    met = keyed.join(table.hint("merge"), ["prefix", "ext"]).where(F.rlike("path", F.col("rx")))
    touched = written(met.groupBy("path", "k").agg(F.bool_and("included").alias("ok")).where("ok").select("path", "k"), "touched")
    sets = changes.select(*KEY, F.concat_ws("/", "owner", "repo").alias("name"), "path")
    by_path = sets.join(touched.hint("merge"), "path").select(*KEY, "name", "k").distinct()
    repos = spark.createDataFrame([(k, name) for k, r in used if r.scope == "repo" for name in set(r.repos)], "k int, name string")
    wide = spark.createDataFrame([(k, name) for k, r in used if r.scope == "repo" and not r.paths for name in set(r.repos)], "k int, name string")
    names = spark.createDataFrame([(k, r.scope, r.rule_id) for k, r in used], "k int, scope string, rule_id string")
    scoped = by_path.join(names.hint("merge"), "k")
    local = scoped.where("scope = 'path'").select(*KEY, "rule_id").unionByName(scoped.where("scope = 'repo'").join(repos.hint("merge"), ["k", "name"], "left_semi").select(*KEY, "rule_id"))
    owned = sets.select(*KEY, "name").distinct()
    local = local.unionByName(owned.join(wide.hint("merge"), "name").join(names.hint("merge"), "k").select(*KEY, "rule_id"))
    everywhere = F.array(*[F.lit(x) for x in sorted(r.rule_id for _, r in used if r.scope == "global")[:cap]]).cast("array<string>")
    own = owned.select(*KEY, F.explode_outer(everywhere).alias("rule_id")).where("rule_id is not null").withColumn("local", F.lit(False))
    w = Window.partitionBy(*KEY).orderBy("local", "rule_id")
    return own.unionByName(local.withColumn("local", F.lit(True))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select(*KEY, "rule_id", "rank")


def label_set() -> Column:
    """AGG-14: trimmed, distinct, sorted labels of pr_type, risk_tag, domains and ownership_hints; no empty ones."""
    none = F.array().cast("array<string>")
    lists = [F.array("pr_type", "risk_tag"), *[F.coalesce(F.col(c), none) for c in ("domains", "ownership_hints")]]
    trimmed = F.transform(F.concat(*lists), lambda x: strip_ws(F.coalesce(x, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def stale_labels(existing: Column, fresh: Column) -> Column:
    """AGG-14: existing labels of an exclusive kind that the fresh set no longer has.

    Risk labels always are of such a kind, types only if the fresh set names a type.
    """
    low = F.transform(fresh, F.lower)
    typed = F.exists(low, lambda x: x.isin(*PR_TYPES))
    return F.filter(
        existing,
        lambda x: (F.lower(x).startswith("risk/") | (typed & F.lower(x).isin(*PR_TYPES))) & ~F.array_contains(low, F.lower(x)),
    )


def diffs_of(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT-18: the changes whose (owner, repo, pr, path) is asked for; unknown paths give no row."""
    return changes.join(wanted.select(*KEY, "path").distinct(), [*KEY, "path"], "left_semi")


class Rooms:
    """Free room of chunks in a binary tree of maxima: the first chunk with enough room in log n steps."""

    def __init__(self) -> None:
        self.size, self.n, self.tree = 1, 0, [-1, -1]

    def _set(self, at: int, room: int) -> None:
        i = self.size + at
        self.tree[i] = room
        while i > 1:
            i //= 2
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def add(self, room: int) -> int:
        if self.n == self.size:
            leaves = self.tree[self.size :]
            self.size *= 2
            self.tree = [-1] * self.size + leaves + [-1] * len(leaves)
            for i in range(self.size - 1, 0, -1):
                self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        self._set(self.n, room)
        self.n += 1
        return self.n - 1

    def take(self, at: int, amount: int) -> None:
        self._set(at, self.tree[self.size + at] - amount)

    def first(self, need: int) -> int | None:
        if self.tree[1] < need:
            return None
        i = 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] >= need else 2 * i + 1
        return i - self.size


def in_order(items: DataFrame, by: Sequence[str], order: Sequence[str], inputs: Sequence[str], begin: Callable[[], Callable], added: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Rows whose fate depends on all before them in their group: ``keep`` (default all) and what a step adds to each.

    ``begin()`` gives a group's step; it is called with ``inputs`` of the group's rows in ``order`` (nulls last) and
    returns the values of ``added`` (integer, long or string by name), or None for a row that goes. Groups lie one after another in a task's sorted
    stream: a small group costs its rows only, and of a large one a batch is in memory.
    """
    keep = list(keep or items.columns)
    kinds = [{"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}[t] for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = step = None
        for batch in batches:
            keys, values = (zip(*[batch.column(c).to_pylist() for c in cols], strict=True) for cols in (by, inputs))
            out = []
            for k, x in zip(keys, values, strict=True):
                if step is None or k != key:
                    key, step = k, begin()
                out.append(step(*x))
            got = batch.select(keep).filter(pa.array([x is not None for x in out], pa.bool_()))
            more = [pa.array([x[i] for x in out if x is not None], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*got.columns, *more], names=[*keep, *added])

    schema = T.StructType([items.schema[c] for c in keep])
    for c, t in added.items():
        schema = schema.add(c, t)
    rows = items.select(*dict.fromkeys([*by, *order, *inputs, *keep])).repartition(*by).sortWithinPartitions(*by, *[F.col(c).asc_nulls_last() for c in order])
    return rows.mapInArrow(run, schema)


def first_fit(items: DataFrame, limit: int, *by: str) -> DataFrame:
    """WIN-3: adds ``chunk`` (from 0): the first chunk of the group with room, in order of ``ord``.

    An item of more than ``limit`` tokens, and every item if ``limit`` < 1, is a chunk of its own
    (which stays closed, being full). The choice depends on all before it, so a group (a change
    set's files) is one task's work: their sizes and numbers only, n log n steps; groups run in parallel.
    """

    def begin() -> Callable:
        rooms = Rooms()

        def step(n: int | None) -> tuple[int]:
            fits = n is not None and 0 < limit and n <= limit
            at = rooms.first(n) if fits else None
            if at is None:
                return (rooms.add(limit - n if fits else -1),)
            rooms.take(at, n)
            return (at,)

        return step

    return in_order(items, by, ["ord"], ["tokens"], begin, {"chunk": "integer"})


def fitting_items(items: DataFrame, budget: int, *by: str) -> DataFrame:
    """WIN-5b: items in order of ``ord`` that still fit the group's byte budget; others are skipped.

    As for :func:`first_fit`, a group is one task's work.
    """

    def begin() -> Callable:
        used = 0

        def step(n: int | None) -> tuple | None:
            nonlocal used
            if n is None or used + n > budget:
                return None
            used += n
            return ()

        return step

    return in_order(items, by, ["ord"], ["n_bytes"], begin, {})


#: What an excerpt ends with where it was cut.
CUT = "\n// ... (truncated)"
#: Bytes of the source budget that stay free for a block's header.
HEADER_ROOM = 256


def import_excerpts(candidates: DataFrame, max_files: int = 8, per_file: int = 1500, budget: int = 12_000) -> DataFrame:
    """WIN-5c: excerpts of imported files for each change set: owner, repo, pr, path, importer, excerpt, n_bytes, rank.

    ``candidates``: key, importer_ord, ord, importer, path, content: what the changed files import, in
    order; changed files are not among them. A path counts once, blank excerpts don't. Files are
    taken until ``max_files`` or ``budget`` bytes; one that would exceed the budget ends its importer,
    and the next importer goes on. The choice depends on all before it, so a change set's
    candidates are one task's work: their sizes only, texts are cut before and joined after.
    """
    text = excerpt(F.col("content"), per_file, CUT)
    d = candidates.where(empty(F.col("content")) != "").withColumn("excerpt", text).where(strip_ws(F.col("excerpt")) != "")
    lang = F.coalesce(F.nullif(language(F.col("path")), F.lit("")), language(F.col("importer")))
    block = F.octet_length(F.concat(F.lit("### `"), "path", F.lit("` (imported by `"), "importer", F.lit("`)\n```"), lang, F.lit("\n"), "excerpt", F.when(F.col("excerpt").endswith("\n"), "").otherwise("\n"), F.lit("```")))
    d = d.withColumn("n_bytes", block.cast("long"))
    first = Window.partitionBy(*KEY, "path").orderBy("importer_ord", "ord")
    d = d.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")

    def begin() -> Callable:
        used, full, taken = 0, (), 0

        def step(importer: int, n: int | None) -> tuple[int] | None:
            nonlocal used, full, taken
            if taken < max_files and used < budget and importer != full and n is not None and used + n <= budget:
                used, taken = used + n, taken + 1
                return (taken,)
            if taken < max_files and importer != full:
                full = importer
            return None

        return step

    kept = in_order(d, KEY, ["importer_ord", "ord"], ["importer_ord", "n_bytes"], begin, {"rank": "integer"}, keep=[*KEY, "path"])
    return d.join(kept.hint("merge"), [*KEY, "path"]).select(*KEY, "path", "importer", "excerpt", "n_bytes", "rank")


def source_excerpts(files: DataFrame, budget: int) -> DataFrame:
    """Source blocks of a change set in order of ``ord``: owner, repo, pr, path, excerpt, n_bytes, ord.

    ``files``: key, path, ord, content. A file is cut to what is left of ``budget`` bytes less
    :data:`HEADER_ROOM`; one whose block still doesn't fit is skipped. As for :func:`first_fit`, a
    group is one task's work; no more than ``budget`` bytes of a file reach it.
    """
    head = F.substring(F.encode("content", "utf-8"), 1, budget)
    d = files.where(empty(F.col("content")) != "").select(*KEY, "path", "ord", head.alias("head"), F.octet_length("content").alias("size"))
    d = d.withColumn("fence", F.octet_length(F.concat("path", F.regexp_replace(extension(F.col("path")), r"^\.", ""))) + 18)

    def begin() -> Callable:
        used = 0

        def step(head: bytes, size: int, fence: int) -> tuple[str, int] | None:
            nonlocal used
            room = budget - used - HEADER_ROOM
            if used >= budget or room <= 0:
                return None
            text = bytes(head)
            if size > room:
                text = text[:room]
                at = text.rfind(b"\n")
                text = (text[:at] if at > 0 else text) + CUT.encode()
            n = len(text) + fence
            if not text.strip() or used + n > budget:
                return None
            used += n
            return text.decode("utf-8", "replace"), n

        return step

    got = in_order(d, KEY, ["ord"], ["head", "size", "fence"], begin, {"excerpt": "string", "n_bytes": "long"}, keep=[*KEY, "path", "ord"])
    return got.select(*KEY, "path", "excerpt", "n_bytes", "ord")


def _within(lines: DataFrame, budget: int, header: int) -> DataFrame:
    """Lines of a section in order, as long as they end inside the budget; ``header`` bytes stand before them."""
    w = Window.partitionBy(*KEY).orderBy("related", "path").rowsBetween(Window.unboundedPreceding, 0)
    # a blank line and a heading, 48 bytes, stand before the first related file
    lead = F.when(F.col("related") & (F.row_number().over(Window.partitionBy(*KEY, "related").orderBy("path")) == 1), 48).otherwise(0)
    d = lines.withColumn("n_bytes", (F.octet_length("line") + 1).cast("long")).withColumn("lead", lead)
    d = d.withColumn("used", F.sum(F.col("n_bytes") + F.col("lead")).over(w) + header)
    return d.where(F.col("used") <= budget)


def context_sections(changed: DataFrame, blast: DataFrame, contents: DataFrame, summaries: DataFrame, imports: DataFrame, directories: DataFrame, tokens: int = 8000) -> DataFrame:
    """WIN-6: what a review's context holds: owner, repo, pr, section, path, n_bytes.

    ``tokens`` * 4 bytes are split 60 : 30 : 10 over source excerpts, file summaries and directory
    lines. Sources go to the changed files by inbound edges (``changed``: key, path, n_inbound, ord),
    then to the ``blast`` radius (key, path, n_symbols, depth) by affected symbols. Files without
    source get their summary line, then those that changed files import (``imports``: repo,
    source_path, target_path) do. ``summaries``: repo, path, summary; ``directories``: repo, path,
    summary, n_files; ``contents``: repo, path, content. Summary and directory lines are cut by
    running sums; only the source section is sequential (see :func:`source_excerpts`).
    """
    bytes_ = tokens * 4
    c = changed.select(*KEY, "path", F.struct(F.lit(0).alias("kind"), (-F.col("n_inbound")).cast("long").alias("a"), F.col("ord").cast("long").alias("b"), F.lit("").alias("c")).alias("ord"))
    near = blast.join(changed.select(*KEY, "path"), [*KEY, "path"], "left_anti")
    b = near.select(*KEY, "path", F.struct(F.lit(1).alias("kind"), (-F.col("n_symbols")).cast("long").alias("a"), F.col("depth").cast("long").alias("b"), F.col("path").alias("c")).alias("ord"))
    order = c.unionByName(b)
    place = Window.partitionBy(*KEY).orderBy("ord")
    order = order.withColumn("ord", F.row_number().over(place))
    # written: the summaries depend on it too, and its size is a function's
    source = written(source_excerpts(order.join(contents.select("repo", "path", "content"), ["repo", "path"]), bytes_ * 60 // 100).select(*KEY, "path", "n_bytes"), "sources")

    has = summaries.where(strip_ws(empty(F.col("summary"))) != "")
    line = F.concat(F.lit("- `"), "path", F.lit("`: "), "summary")
    own = changed.select(*KEY, "path").withColumn("related", F.lit(False))
    hop = changed.select(*KEY, F.col("path").alias("source_path")).join(imports.hint("merge"), ["repo", "source_path"]).select(*KEY, F.col("target_path").alias("path")).distinct()
    hop = hop.join(changed.select(*KEY, "path"), [*KEY, "path"], "left_anti").withColumn("related", F.lit(True))
    listed = own.unionByName(hop).join(source.select(*KEY, "path").hint("merge"), [*KEY, "path"], "left_anti").join(has.select("repo", "path", "summary"), ["repo", "path"])
    listed = _within(listed.withColumn("line", line), bytes_ * 30 // 100, len("### File summaries\n"))

    parents = changed.select(*KEY, parent_dir(F.col("path")).alias("path")).where("path <> ''").distinct()
    dirs = parents.join(directories.where(strip_ws(empty(F.col("summary"))) != "").select("repo", "path", "summary", "n_files"), ["repo", "path"])
    line = F.concat(F.lit("- `"), "path", F.lit("/`: "), "summary", F.lit(" ("), F.col("n_files").cast("string"), F.lit(" files)"))
    dirs = _within(dirs.withColumn("related", F.lit(False)).withColumn("line", line), bytes_ * 10 // 100, len("### Directory context\n"))
    part = lambda df, name: df.select(*KEY, F.lit(name).alias("section"), "path", "n_bytes")
    return part(source, "source").unionByName(part(listed, "summary")).unionByName(part(dirs, "directory"))


def review_context(sections: DataFrame, candidates: DataFrame, **limits) -> DataFrame:
    """WIN-6 with its fallback: the sections of each change set, and where the index gave none, excerpts of what it imports.

    ``sections`` as from :func:`context_sections`, ``candidates`` as for :func:`import_excerpts` (WIN-5c), whose files
    become the section 'imported'.
    """
    without = candidates.join(sections.select(*KEY).distinct().hint("merge"), list(KEY), "left_anti")
    excerpts = import_excerpts(without, **limits)
    return sections.unionByName(excerpts.select(*KEY, F.lit("imported").alias("section"), "path", "n_bytes"))
