"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior (operator 13).

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Hosts up to this number are broadcast to the documents (under 100 bytes each); more meet them in a shuffle.
BROADCAST_HOSTS = 200_000
#: A host whose shrunk rate of documents that fail the base rules reaches this is blocked.
BLOCKED_RATE = 0.5
#: A host is strict if its shrunk rate of documents that fail any rule reaches this, and this many times the mean.
STRICT_RATE, STRICT_TIMES = 0.25, 2.0
#: The least correlation inside a host that the prior takes: its strength stays finite when hosts don't differ.
LEAST_CORRELATION = 1e-6

SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8


def _paired(span: int) -> F.Column:
    """Hashes of twice as many words as those in ``hashes``, which are of ``span`` words each."""
    starts = F.slice("hashes", 1, F.size("hashes") - span)
    return F.transform(starts, lambda h, i: F.xxhash64(h, F.get("hashes", i + span)))


def text_statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules need, one row a document.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines
    (of those, equal to an earlier one) and n_repeat_words (words in windows of eight that the text
    has twice or more). A null text has no words. Windows are compared by two 64-bit hashes; only
    texts in which the first one repeats are sorted by both.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text")).select(
        "doc_id",
        "host",
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.filter(F.split("text", SPACES), lambda x: x != "").alias("words"),
    )
    window = lambda i: F.slice("words", i, WINDOW)
    d = d.withColumn("hashes", F.when(F.size("words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))))
    span = 1
    while span < WINDOW:  # hashes of 2, 4, 8 words, each from two of half its length
        d, span = d.withColumn("hashes", _paired(span)), 2 * span
    sorted_windows = F.sort_array(
        F.transform("hashes", lambda h, k: F.struct(h.alias("a"), F.xxhash64(F.lit(1), window(k + 1)).alias("b"), k.alias("at")))
    )
    d = d.withColumn("seen", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sorted_windows))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
    repeated = F.filter("seen", lambda x, k: same(x, F.get("seen", k - 1)) | same(x, F.get("seen", k + 1)))
    places = F.sort_array(F.transform(repeated, lambda x: x["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return d.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_failures(stats: DataFrame) -> DataFrame:
    """base_failed (too short, or its windows repeat) and soft_failed (symbols, or repeated lines)."""
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "soft_failed": (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        }
    )


def beta_prior(hosts: DataFrame, failures: str, total: str = "n") -> tuple[float, float]:
    """The beta prior (a, b) of the hosts' failure rates, by moments; (0, 0) without documents.

    The correlation of two documents of a host comes from the hosts' squared deviations, weighted
    by size, against what chance alone would give. One row of sums reaches the driver.
    """
    rate = F.sum(failures) / F.sum(total)
    mean = hosts.agg(rate.alias("m")).first().m
    if mean is None:
        return 0.0, 0.0
    dev = F.col(total) * F.pow(F.col(failures) / F.col(total) - F.lit(mean), 2)
    s = hosts.agg(F.sum(dev).alias("dev"), F.sum(total).alias("n"), F.sum(F.pow(total, 2)).alias("n2"), F.count("*").alias("k")).first()
    chance, spread = mean * (1 - mean), s.n - s.n2 / s.n - (s.k - 1)
    rho = (s.dev / chance - (s.k - 1)) / spread if chance > 0 and spread > 0 else LEAST_CORRELATION
    rho = min(max(rho, LEAST_CORRELATION), 1 - LEAST_CORRELATION)
    strength = (1 - rho) / rho
    return mean * strength, (1 - mean) * strength


def host_verdicts(failed: DataFrame) -> DataFrame:
    """host_key, n, base_rate, any_rate (shrunk) and verdict ('blocked', 'strict' or 'trusted') of every host.

    ``failed`` has host, base_failed and soft_failed; a null host is a host of its own.
    """
    hosts = materialize(
        failed.groupBy(host_key().alias("host_key")).agg(
            F.count("*").alias("n"),
            F.count_if("base_failed").alias("base"),
            F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("any"),
        ),
        "op13-hosts",
    )
    rates, means = {}, {}
    for name in ("base", "any"):
        a, b = beta_prior(hosts, name)
        means[name] = a / (a + b) if a + b else 0.0
        rates[f"{name}_rate"] = (F.col(name) + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdict = (
        F.when(F.col("base_rate") >= BLOCKED_RATE, "blocked")
        .when((F.col("any_rate") >= STRICT_RATE) & (F.col("any_rate") >= STRICT_TIMES * means["any"]), "strict")
        .otherwise("trusted")
    )
    return hosts.withColumns(rates).select("host_key", "n", "base_rate", "any_rate", verdict.alias("verdict"))


def host_key() -> F.Column:
    """Equal for equal hosts, and not null."""
    return F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit(""))


def host_rules(docs: DataFrame, host: str = "source", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Rules by document and by host: doc_id, the counts, base_failed, kept, host, verdict.

    A document stays unless it fails the base rules, its host is blocked, or its host is strict
    and it fails a soft rule. A few documents say little about their host: its rates are drawn to
    the mean of all hosts, the more the less hosts differ.

    Null and empty texts have no words and fail; a null host is one of its own; repeated rows count
    each; ties don't occur (rates are compared with fixed thresholds); an empty table gives no rows;
    other columns aren't read, so their names don't matter. Texts are read once and aren't shuffled:
    their counts are written to the shared folder, summed by host before the shuffle, and joined
    with the verdicts, which are broadcast up to ``broadcast_hosts`` hosts.
    """
    counted = materialize(with_failures(text_statistics(docs, host)), "op13-counts", waves=16)
    verdicts = host_verdicts(counted).select("host_key", "verdict")
    verdicts = F.broadcast(verdicts) if verdicts.count() <= broadcast_hosts else verdicts.hint("merge")
    soft = (F.col("verdict") == "strict") & F.col("soft_failed")
    kept = ~(F.col("base_failed") | (F.col("verdict") == "blocked") | soft)
    return (
        counted.withColumn("host_key", host_key())
        .join(verdicts, "host_key")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host", "verdict")
    )


#: The rows of ``host_rules`` over documents, in DuckDB SQL.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, i, list_slice(words, i, i + 7) AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM p) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(i - before, 8))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again) GROUP BY r),
c AS (SELECT doc_id, host, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS soft_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS base, count(*) FILTER (base_failed OR soft_failed) AS any_ FROM f GROUP BY host),
m AS (SELECT sum(base) / sum(n) AS base, sum(any_) / sum(n) AS any_ FROM h),
s AS (SELECT sum(h.n * pow(h.base / h.n - m.base, 2)) AS d1, sum(h.n * pow(h.any_ / h.n - m.any_, 2)) AS d2,
    sum(h.n) - sum(h.n * h.n) / sum(h.n) - (count(*) - 1) AS spread, count(*) - 1 AS k1 FROM h, m),
rho AS (SELECT least(greatest(CASE WHEN m.base * (1 - m.base) > 0 AND spread > 0 THEN (d1 / (m.base * (1 - m.base)) - k1) / spread ELSE 0 END, 1e-6), 1 - 1e-6) AS base,
    least(greatest(CASE WHEN m.any_ * (1 - m.any_) > 0 AND spread > 0 THEN (d2 / (m.any_ * (1 - m.any_)) - k1) / spread ELSE 0 END, 1e-6), 1 - 1e-6) AS any_ FROM s, m),
rates AS (SELECT h.host, (h.base + m.base * (1 - rho.base) / rho.base) / (h.n + (1 - rho.base) / rho.base) AS base_rate,
    (h.any_ + m.any_ * (1 - rho.any_) / rho.any_) / (h.n + (1 - rho.any_) / rho.any_) AS any_rate, m.any_ AS mean FROM h, m, rho),
v AS (SELECT host, CASE WHEN base_rate >= 0.5 THEN 'blocked' WHEN any_rate >= 0.25 AND any_rate >= 2 * mean THEN 'strict' ELSE 'trusted' END AS verdict FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR verdict = 'blocked' OR (verdict = 'strict' AND soft_failed)) AS kept, f.host, verdict
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
