"""URL filters by a temporal list join (operator 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Lookups (distinct host and day) for each copy of the list, and the most copies: one for small inputs.
SALT_ROWS, MOST_SALTS = 1_000_000, 64
#: Public suffixes of two labels, which are nobody's domain; a longer list is a parameter.
PUBLIC_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za")


def host_of(url: F.Column) -> F.Column:
    """Lower-case host of an absolute URL, without user, port or trailing dot; '' if there is none. IPv6 keeps its brackets."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.lower(F.regexp_replace(h, r"\.$", ""))


def suffixes(host: F.Column, public: tuple[str, ...] = PUBLIC_SUFFIXES) -> F.Column:
    """The host and its parent domains down to two labels, as (suffix, labels) structs; no public suffixes, and IPs have no parents."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    alone = (n <= 2) | host.rlike(r"^\[|^\d{1,3}(?:\.\d{1,3}){3}$")
    starts = F.when(alone, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n - 1))
    every = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(parts, i, n), ".").alias("suffix"), (n - i + 1).alias("labels")))
    return F.filter(every, lambda s: (s["labels"] == n) | ~s["suffix"].isin(*public))


def validity(entries: DataFrame) -> DataFrame:
    """domain, action, valid_from, valid_to (null: still open) of dated (domain, day, action) entries.

    Within a domain an entry holds until the next one; on one day the last action in text order
    counts. Entries with a null domain, day or action are left out.
    """
    e = (
        entries.where("domain is not null and day is not null and action is not null")
        .groupBy(F.lower("domain").alias("domain"), "day")
        .agg(F.max("action").alias("action"))
    )
    w = Window.partitionBy("domain").orderBy("day")
    return e.select("domain", "action", F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_to"))


def temporal_filter(captures: DataFrame, entries: DataFrame, bucket_days: int = 32) -> DataFrame:
    """Every capture with the list entry that was active when it was fetched.

    ``captures``: page_id, url, fetched (date). ``entries``: domain, day, action. Returns page_id,
    host, fetched, matched (domain or null), action, valid_from, blocked. Of the host and its
    parents the longest domain with an active entry decides; blocked is true if its action is
    'block'. Captures without a usable URL or date match nothing, but stay; repeated rows stay.

    Plan: distinct (url, fetched) pairs are looked up once, so a hot page costs one lookup.
    Intervals are cut at multiples of ``bucket_days`` within the captures' span, and both sides
    meet on (domain, bucket, salt): an equality join in which a long history or a hot host is
    spread over many tasks. The salt copies the list, not the captures, and only as often as the
    number of lookups asks for. A url is read whole, however long; an empty table gives no rows, an
    empty list matches nothing; other columns, whatever their names, play no part.
    """
    base = captures.select("page_id", "url", "fetched").withColumn("host", host_of(F.col("url")))
    span = base.agg(F.min("fetched"), F.max("fetched")).first()
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / bucket_days)
    lookups = materialize(base.where("host <> '' and fetched is not null").select("host", "fetched").distinct(), "op10-lookups")
    salts = min(MOST_SALTS, 1 + lookups.count() // SALT_ROWS)
    keyed = lookups.withColumn("s", F.explode(suffixes(F.col("host")))).select(
        "host", "fetched", F.col("s.suffix").alias("domain"), F.col("s.labels").alias("labels"), bucket(F.col("fetched")).alias("bucket"),
        F.pmod(F.xxhash64("host", "fetched"), F.lit(salts)).cast("int").alias("salt"),
    )
    lo, hi = F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")
    spans = validity(entries).where((F.col("valid_from") <= hi) & (F.coalesce("valid_to", F.date_add(hi, 1)) > lo))
    first, last = F.greatest("valid_from", lo), F.least(F.coalesce(F.date_sub("valid_to", 1), hi), hi)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(first), bucket(last)))).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    spans = materialize(spans, "op10-intervals")
    hit = keyed.join(spans.hint("merge"), ["domain", "bucket", "salt"]).where(
        (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    best = hit.groupBy("host", "fetched").agg(F.max(F.struct("labels", "domain", "action", "valid_from")).alias("b"))
    best = materialize(best.select("host", "fetched", F.col("b.domain").alias("matched"), F.col("b.action").alias("action"), F.col("b.valid_from").alias("valid_from")), "op10-best")
    out = base.join(best.hint("merge"), ["host", "fetched"], "left")
    return out.select("page_id", "host", "fetched", "matched", "action", "valid_from", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


#: The date on which derived captures begin.
FIRST_DAY = "2024-01-01"


def _hash8(*cols) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the table has no fetch time, so it follows from page_id (one of 365 days)."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(365)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own domains: for two in five domains (host or parent), four
    changes on days given by a hash, alternately 'block' and 'allow' with a final 'lift'."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domains = hosts.select(F.explode(suffixes(F.col("host"))).alias("s")).select(F.col("s.suffix").alias("domain")).distinct()
    listed = domains.where(_hash8("domain") % 5 < 2)
    rows = listed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (_hash8("domain", F.col("k").cast("string")) % 400 - 20).cast("int"))
    return rows.select("domain", day.alias("day"), F.when(F.col("k") == 3, "lift").when(F.col("k") % 2 == 0, "block").otherwise("allow").alias("action"))


SQL = rf"""
WITH base AS (
  SELECT page_id, url, CAST(DATE '{FIRST_DAY}' + CAST(((page_id % 365) + 365) % 365 AS INT) AS DATE) AS fetched,
    lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1), '\.$', '')) AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM base WHERE host <> ''),
parts AS (SELECT host, string_split(host, '.') AS p FROM hosts),
suf AS (SELECT host, array_to_string(p[i:], '.') AS domain, len(p) - i + 1 AS labels
  FROM parts, unnest(CASE WHEN len(p) > 2 AND NOT regexp_matches(host, '^\[|^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN range(1, len(p)) ELSE [1] END) AS t(i)
  WHERE i = 1 OR array_to_string(p[i:], '.') NOT IN {PUBLIC_SUFFIXES}),
listed AS (SELECT DISTINCT domain FROM suf WHERE CAST('0x' || substr(md5(domain), 1, 8) AS BIGINT) % 5 < 2),
entries AS (SELECT domain, CAST(DATE '{FIRST_DAY}' + CAST(CAST('0x' || substr(md5(domain || '|' || k), 1, 8) AS BIGINT) % 400 - 20 AS INT) AS DATE) AS day,
    CASE WHEN k = 3 THEN 'lift' WHEN k % 2 = 0 THEN 'block' ELSE 'allow' END AS action
  FROM listed, range(0, 4) AS r(k)),
days AS (SELECT domain, day, max(action) AS action FROM entries GROUP BY domain, day),
spans AS (SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM days),
hits AS (SELECT b.page_id, s.labels, v.domain, v.action, v.valid_from
  FROM base b JOIN suf s ON s.host = b.host JOIN spans v ON v.domain = s.domain AND v.valid_from <= b.fetched AND (v.valid_to IS NULL OR b.fetched < v.valid_to)),
best AS (SELECT page_id, arg_max(domain, labels) AS matched, arg_max(action, labels) AS action, arg_max(valid_from, labels) AS valid_from FROM hits GROUP BY page_id)
SELECT b.page_id, b.host, b.fetched, t.matched, t.action, t.valid_from, coalesce(t.action = 'block', false) AS blocked
FROM base b LEFT JOIN best t ON t.page_id = b.page_id
"""
