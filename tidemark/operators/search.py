"""Search and windows over source text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.filetype import language
from tidemark.functions.text import basename, empty, extension
from tidemark.operators.selection import matches
from tidemark.sources.shared import written

#: Extensionless names that file search shows.
NAMED = ("Makefile", "Dockerfile", "LICENSE", "README", "Gemfile")
#: Secret shapes by language, for line search.
SECRET_RULES = {
    "hardcoded-secret": r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']",
    "aws-access-key": r"\"(AKIA|ASIA)[0-9A-Z]{16}\"",
}
# The same shapes as rules of languages.
_ASSIGNED = r"\s*=\s*[\"'][A-Za-z0-9_\-]{20,}[\"']"
LANGUAGE_RULES = (
    ("go-hardcoded-aws-access-key", ("go",), r"\"(AKIA|ASIA)[0-9A-Z]{16}\""),
    ("js-hardcoded-secret", ("javascript", "typescript"), r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']"),
    ("py-hardcoded-secret", ("python",), r"(?i)(api[_-]?key|secret|password|token)" + _ASSIGNED),
    ("rb-hardcoded-secret", ("ruby",), r"(?i)(api[_-]?key|secret|password|token)" + _ASSIGNED),
)


def lines(files: DataFrame) -> DataFrame:
    """repo, path, line_no (from 1), line."""
    split = F.split(F.regexp_replace(empty(F.col("content")), r"\n\z", ""), "\n")
    return files.where(empty(F.col("content")) != "").select("repo", "path", F.posexplode(split).alias("at", "line")).select("repo", "path", (F.col("at") + 1).alias("line_no"), "line")


def code_search(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True, globs: Sequence[str] = (), per_file: int = 100) -> DataFrame:
    """FLT-15: matching lines, at most ``per_file`` a file. Files that can't match are dropped before the lines are split."""
    text = lambda c: F.lower(c) if ignore_case else c
    if regex:
        hit = lambda c: c.rlike(("(?i)" if ignore_case else "") + pattern)
        files = files.where(matches(F.col("path"), globs)) if globs else files
    else:
        want = pattern.lower() if ignore_case else pattern
        hit = lambda c: text(c).contains(want)
        files = (files.where(matches(F.col("path"), globs)) if globs else files).where(hit(F.col("content")))
    w = Window.partitionBy("repo", "path").orderBy("line_no")
    return lines(files).where(hit(F.col("line"))).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_file).drop("nth")


def file_find(files: DataFrame, queries: Sequence[tuple[str, str]], cap: int = 100) -> DataFrame:
    """FLT-16: paths whose base name holds the query; only if no base name does, paths that hold it anywhere.

    ``queries``: (query_id, query) pairs that a caller asks; they become literals of the plan, so
    nothing is joined. Extensionless names other than a few are left out. Whether a query has hits by
    base name is one aggregate over all; the first ``cap`` hits are found before the shuffle.
    """
    p = F.col("path")
    shown = (extension(p) != "") | basename(p).isin(*NAMED)
    low, base = F.lower(p), F.lower(basename(p))
    found = F.array_compact(F.array(*[F.when(low.contains(q.lower()), F.struct(F.lit(i).alias("query_id"), base.contains(q.lower()).alias("by_base"))) for i, q in queries]))
    hit = files.select("repo", "path").where(shown).select("repo", "path", F.explode(found).alias("h")).select("repo", "path", "h.query_id", "h.by_base")
    w = Window.partitionBy("query_id", "by_base").orderBy("path", "repo")
    first = hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    best = Window.partitionBy("query_id")  # at most 2 * cap rows a query
    first = first.withColumn("any_base", F.max("by_base").over(best)).where(F.col("by_base") | ~F.col("any_base"))
    return _ranked(first, cap)


def _ranked(hits: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("path", "repo")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("query_id", "repo", "path", "rank")


def line_window(files: DataFrame, start: int, end: int, cap: int = 500) -> DataFrame:
    """FLT-17: lines start..end, at most ``cap``, with the file's line count and whether it was cut."""
    last = min(end, start + cap - 1)
    total = F.size(F.split(empty(F.col("content")), "\n"))
    part = F.slice(F.split(empty(F.col("content")), "\n"), start, max(0, last - start + 1))
    cut = (F.least(F.lit(end), total) - F.lit(start) + 1) > cap
    return files.select("repo", "path", F.array_join(part, "\n").alias("window"), total.alias("n_lines"), cut.alias("truncated"))


def secret_lines(files: DataFrame, rules: dict[str, str] = SECRET_RULES) -> DataFrame:
    """FLT-21: lines that match a secret rule: repo, path, line_no, rule_id."""
    any_rule = "|".join(f"(?:{r})" for r in rules.values())
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(r), F.lit(name)) for name, r in rules.items()]))
    return lines(files.where(F.col("content").rlike(any_rule))).select("repo", "path", "line_no", F.explode(found).alias("rule_id"))


def priority_prefix(items: DataFrame, budget: int, *by: str) -> DataFrame:
    """WIN-5a: items in order of ``ord`` until the first that would exceed the byte budget."""
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("n_bytes").over(w)).where(F.col("used") <= budget)


def conversation_zones(turns: DataFrame, max_tokens: int = 600, reserved: int = 0, frozen: int = 2) -> DataFrame:
    """WIN-2: 'frozen', 'compress' or 'active' for each message.

    The first messages are frozen. A round is an assistant message and the tool messages right
    behind it; the trailing rounds that fit into 0.8 * max_tokens - reserved stay active. ``fits``
    says that all rounds do.
    """
    limit = int(0.8 * max_tokens) - reserved
    tokens = F.floor((F.octet_length(empty(F.col("text"))) + 3) / 4)
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.select("conv_id", "turn", "role", tokens.alias("tokens")).withColumn("at", F.row_number().over(w))
    open_part = F.col("at") > frozen
    d = d.withColumn("round", F.sum(F.when(open_part & (F.col("role") == "assistant"), 1).otherwise(0)).over(w))
    breaks = F.max(F.when(open_part & ~F.col("role").isin("assistant", "tool"), F.col("at"))).over(w)
    head = F.max(F.when(open_part & (F.col("role") == "assistant"), F.col("at"))).over(w)
    in_round = open_part & (F.col("round") > 0) & F.col("role").isin("assistant", "tool") & (F.coalesce(breaks, F.lit(0)) < head)
    d = d.withColumn("in_round", in_round)
    back = Window.partitionBy("conv_id").orderBy(F.desc("round")).rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("suffix", F.sum(F.when(F.col("in_round"), F.col("tokens")).otherwise(0)).over(back))
    every = Window.partitionBy("conv_id")
    ok = F.col("in_round") & (F.col("suffix") <= limit)
    d = d.withColumn("first", F.min(F.when(ok, F.col("at"))).over(every)).withColumn("fits", F.coalesce(F.bool_and(F.when(F.col("in_round"), ok)).over(every), F.lit(True)))
    zone = F.when(F.col("at") <= frozen, "frozen").when(F.col("at") >= F.col("first"), "active").otherwise("compress")
    return d.select("conv_id", "turn", "role", "tokens", zone.alias("zone"), "fits")


def run_totals(runs: DataFrame, *by: str) -> DataFrame:
    """AGG-7: totals and a traffic light histogram of review runs."""
    e, c = F.col("effort_score"), F.col("total_cost_usd")
    bucket = F.when(e > 0, F.when(e <= 3, 0).when(e <= 6, 1).otherwise(2)).otherwise(F.when(c < 0.2, 0).when(c < 1, 1).otherwise(2))
    found = F.col("new_findings") + F.col("carried_findings")
    return runs.withColumn("bucket", bucket).groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.round(F.sum(c), 6).alias("total_cost_usd"), F.sum(found).alias("n_findings"), F.sum("new_findings").alias("n_new"),
        F.expr("sum(duration_ms) div count(*)").alias("avg_duration_ms"),
        *[F.count_if(F.col("bucket") == k).alias(n) for k, n in enumerate(("n_green", "n_yellow", "n_red"))],
    )


def last_runs(runs: DataFrame, n: int = 20, *by: str) -> DataFrame:
    """WIN-7: the last n runs."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("ord"))
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def language_secrets(files: DataFrame, rules: Sequence[tuple[str, Sequence[str], str]] = LANGUAGE_RULES) -> DataFrame:
    """FLT-21: repo, path, line_no, rule_id of the lines that a rule of their file's language finds.

    ``rules``: (rule_id, languages, pattern). Each language has one array of its rules, chosen by the file; files in no
    language of a rule, and texts that none of all patterns is in, go before lines are split.
    """
    lang = language(F.col("path"))
    own: dict[str, list[tuple[str, str]]] = {}
    for rule_id, languages, pattern in rules:
        for name in languages:
            own.setdefault(name, []).append((rule_id, pattern))
    if not own:
        return lines(files).select("repo", "path", "line_no", F.lit("").alias("rule_id")).limit(0)
    any_of = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in dict.fromkeys(p for _, _, p in rules))
    found = None
    for name, mine in own.items():
        hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), r) for r, p in mine]), lambda x: x.isNotNull())
        found = F.when(F.col("lang") == name, hits) if found is None else found.when(F.col("lang") == name, hits)
    kept = files.where(lang.isin(*own) & F.col("content").rlike(any_of))
    d = lines(kept).withColumn("lang", lang)
    return d.select("repo", "path", "line_no", F.explode_outer(found).alias("rule_id")).where("rule_id is not null")


#: Letters of the grams in a search index: a pattern of fewer letters is a gram itself.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct grams of ``n`` letters of a text, without those that hold a line feed; one pass of a look-ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=([^\n]{{{n}}}))"), F.lit(1)))


def search_index(files: DataFrame) -> DataFrame:
    """Postings of a code search: gram, repo, path of all files' texts in lower case, written once to the shared folder."""
    text = F.lower(empty(F.col("content")))
    return written(files.select("repo", "path", F.explode_outer(F.concat(*[_grams(text, k) for k in range(1, GRAM + 1)])).alias("gram")).where("gram is not null"), "postings")


def indexed_search(files: DataFrame, index: DataFrame, queries: DataFrame, per_file: int = 100, shown: int = 100) -> DataFrame:
    """FLT-15 for any number of patterns: query_id, repo, path, line_no, line, n_total, truncated.

    ``queries``: query_id, pattern (one line of text, any case). Each pattern is looked up by its rarest gram, whose
    postings are the files to read; those are searched line by line, so the result is that of a scan. At most
    ``per_file`` lines of a file; n_total counts a query's lines, and from ``shown`` on the answer is marked truncated.
    """
    asked = written(queries.where(F.coalesce("pattern", F.lit("")) != "").select("query_id", F.lower("pattern").alias("pattern")).distinct(), "patterns")
    whole = F.when(F.length("pattern") < GRAM, F.array("pattern")).otherwise(_grams(F.col("pattern"), GRAM))
    grams = written(asked.select("query_id", "pattern", F.explode_outer(whole).alias("gram")).where("gram is not null"), "pattern-grams")
    wanted = index.join(grams.select("gram").distinct().hint("merge"), "gram", "left_semi")
    often = wanted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(often.hint("merge"), "gram", "left").groupBy("query_id", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = written(rarest.select("query_id", "pattern", F.col("r.gram").alias("gram")), "rarest-grams")
    candidates = index.join(rarest.hint("merge"), "gram").select("repo", "path", "query_id", "pattern")
    read = candidates.join(files.select("repo", "path", "content").hint("merge"), ["repo", "path"])
    split = F.transform(F.split(F.regexp_replace(empty(F.col("content")), r"\n\z", ""), "\n"), lambda x, k: F.struct((k + 1).alias("line_no"), x.alias("line")))
    hits = F.slice(F.filter(split, lambda x: F.lower(x["line"]).contains(F.col("pattern"))), 1, per_file)
    found = written(read.select("query_id", "repo", "path", F.explode_outer(hits).alias("h")).where("h is not null").select("query_id", "repo", "path", "h.line_no", "h.line"), "search-hits")
    totals = found.groupBy("query_id").agg(F.count("*").alias("n_total"))
    return found.join(totals.hint("merge"), "query_id").withColumn("truncated", F.col("n_total") >= shown)


#: Letters of the piece by which a pattern is looked up in :func:`search_many`; a shorter pattern is its own piece.
PIECE = 8


def search_many(files: DataFrame, queries: DataFrame, per_file: int = 100, shown: int = 100) -> DataFrame:
    """FLT-15 for any number of patterns in one pass over the texts; takes and returns what :func:`indexed_search` does.

    The index is one of the patterns: each is looked up by its first letters among those of every place of every line, and
    compared with the line where they meet. Texts are not shuffled, and of the hits only those in files of more than ``per_file`` lines are.
    Queries of equal pattern share their hits, which are stored once; a query's own are only rows of the result. The tables of
    patterns and queries, small next to the texts, go to all executors.
    """
    named = queries.where(F.coalesce("pattern", F.lit("")) != "").select("query_id", F.lower("pattern").alias("pattern"))
    asked = named.groupBy("pattern").agg(F.collect_set("query_id").alias("query_ids")).withColumn("piece", F.substring("pattern", 1, PIECE))
    asked = written(asked.withColumn("id", F.monotonically_increasing_id()), "patterns")
    lengths = sorted(r[0] for r in asked.select(F.length("piece")).distinct().collect())
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *[_grams(F.lower("line"), n) for n in lengths]))

    def hits(some: DataFrame) -> DataFrame:
        at = lines(some).select("repo", "path", "line_no", "line", F.explode_outer(pieces).alias("piece")).where("piece is not null")
        at = at.join(F.broadcast(asked.select("piece", "id", "pattern")), "piece")
        return at.where(F.lower("line").contains(F.col("pattern"))).select("id", "repo", "path", "line_no", "line")

    content = empty(F.col("content"))
    is_long = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) >= per_file
    w = Window.partitionBy("id", "repo", "path").orderBy("line_no")
    first = hits(files.where(is_long)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_file).drop("nth")
    found = written(hits(files.where(~is_long)).unionByName(first), "search-hits")
    counts = found.groupBy("id").agg(F.count("*").alias("n"))
    answers = asked.select("id", F.explode("query_ids").alias("query_id")).join(counts.hint("merge"), "id")
    answers = answers.select("id", "query_id", F.sum("n").over(Window.partitionBy("query_id")).alias("n_total"))
    out = found.join(F.broadcast(answers), "id").select("query_id", "repo", "path", "line_no", "line", "n_total")
    return out.withColumn("truncated", F.col("n_total") >= shown)
