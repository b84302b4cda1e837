"""Scalar functions over paths, snippets, findings and model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters of Unicode's White_Space property.
WHITE_SPACE = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last suffix of the base name, with its dot; '' if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def byte_prefix(c: Column, n: int) -> Column:
    """The first n bytes of the UTF-8 form; a cut character becomes U+FFFD."""
    return F.substring(F.encode(c, "utf-8"), 1, n).cast("string")


# --- identity of findings ------------------------------------------------------------------------

#: Everything of a line before a comment sign that is outside strings and URL schemes.
_CODE = (
    r'(?md)^((?:"""(?:(?!""")[^\n])*+(?:"""|$)|"(?:\\[^\n]|\\$|[^"\\\n])*+(?:"|$)|'
    r"'(?:\\[^\n]|\\$|[^'\\\n])*+(?:'|$)|`[^`\n]*+(?:`|$)|"
    r"(?<=(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]{0,40}:)//|/(?!/)|[^"
    r'"'
    r"'`#/\n])*+)(?://|#)[^\n]*"
)


def normalize_snippet(c: Column) -> Column:
    """Line-number prefixes and line comments go, runs of white space become one space."""
    c = F.regexp_replace(empty(c), r"(?md)^\s*\d+\s*[:|]?\s*", "")
    c = F.regexp_replace(c, _CODE, "$1")
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def normalize_path(c: Column) -> Column:
    """The extension in lower case, the rest as it is."""
    p = strip_ws(empty(c))
    e = extension(p)
    return F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(e)), F.lower(e))


def line_symbol(start: Column, end: Column) -> Column:
    """'L{start}-{end}', or '' for a finding without a place."""
    return F.when((start == 0) & (end == 0), F.lit("")).otherwise(F.concat(F.lit("L"), start.cast("string"), F.lit("-"), end.cast("string")))


def fingerprint(owner: Column, repo: Column, category: Column, path: Column, symbol: Column, snippet: Column) -> Column:
    parts = [strip_ws(empty(owner)), strip_ws(empty(repo)), strip_ws(empty(category)), normalize_path(path), strip_ws(empty(symbol)), normalize_snippet(snippet)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def finding_key(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(empty(path), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), byte_prefix(empty(content), 64))


# --- redaction -----------------------------------------------------------------------------------

# Shapes of credentials.
_PEM = r"(?s)(-----BEGIN [A-Z0-9 ]+-----).*?(-----END [A-Z0-9 ]+-----)"
_JWT = r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}\b"
_BASIC = r"(https?://)[^\s:/@]+:[^\s@]+@"
_ENV_KEY = (
    r"(?imd)^([ \t]*[+\-]?[ \t]*(?:export\s+)?)([A-Z][A-Z0-9_]*(?:_API_KEY|_TOKEN|_SECRET|_PASSWORD|_PRIVATE_KEY)"
    r"|AWS_[A-Z0-9_]*_(?:KEY|TOKEN|SECRET)|PASSWORD|PRIVATE_KEY)\s*=\s*"
)
_PREFIXED = (
    r"\b(?:sk-ant-[A-Za-z0-9_\-]{20,}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}"
    r"|xoxb-[A-Za-z0-9\-]{20,}|AKIA[0-9A-Z]{16})\b"
)


def redact_secrets(c: Column) -> Column:
    """PEM blocks, then tokens, URL passwords, assignments (placeholders stay) and prefixed keys."""
    c = F.regexp_replace(c, _PEM, "$1\n[REDACTED-PEM]\n$2")
    c = F.regexp_replace(c, _JWT, "[REDACTED-JWT]")
    c = F.regexp_replace(c, _BASIC, "$1[REDACTED]@")
    keep = r"(?!{q}*(?:\.\.\.|…|<[^\n]*>)?{q}*(?:\s|$))"
    c = F.regexp_replace(c, _ENV_KEY + keep.format(q='"') + r'"[^"\n]*"', '$1$2="[REDACTED]"')
    c = F.regexp_replace(c, _ENV_KEY + keep.format(q="'") + r"'[^'\n]*'", "$1$2='[REDACTED]'")
    c = F.regexp_replace(c, _ENV_KEY + keep.format(q="[\"']") + r"(?![\"'])\S+", "$1$2=[REDACTED]")
    return F.regexp_replace(c, _PREFIXED, "[REDACTED]")


def redact_match(match: Column, secret: Column, mark: str = "***REDACTED***") -> Column:
    """The first occurrence of the secret in its match is masked; all of it if it isn't there."""
    i = F.instr(match, secret)
    n = F.length(secret)
    cut = F.concat(F.substring(match, F.lit(1), i - 1), F.lit(mark), F.substring(match, i + n, F.length(match)))
    return F.when(F.length(empty(secret)) == 0, F.lit(mark)).when(i > 0, cut).otherwise(F.lit(mark))


# --- measures ------------------------------------------------------------------------------------


def words_of(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(empty(c)), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 when a side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def tokens_up(c: Column) -> Column:
    """ceil(bytes / 4): the selector's estimate."""
    return F.floor((F.octet_length(empty(c)) + 3) / 4)


def tokens_down(c: Column) -> Column:
    """floor(bytes / 4): the context budget's estimate."""
    return F.floor(F.octet_length(empty(c)) / 4)


def lines_of_code(c: Column) -> Column:
    """Line feeds, plus one for an unfinished last line; 0 if empty."""
    c = empty(c)
    return F.when(F.length(c) == 0, 0).otherwise(F.size(F.split(c, "\n")) - F.when(c.endswith("\n"), 1).otherwise(0))


def churn(diff: Column) -> Column:
    """Added and deleted lines of a diff body; '+++' and '---' headers don't count."""
    lines = F.split(empty(diff), "\n")
    hit = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return F.struct(hit("+").alias("added"), hit("-").alias("deleted"))


def excerpt(c: Column, budget: int, marker: str = "\n... (truncated)") -> Column:
    """At most ``budget`` bytes, cut back to a line end, with a marker if anything was cut."""
    cut = F.regexp_replace(byte_prefix(c, budget), r"\n[^\n]*\z", "")
    return F.when(F.octet_length(c) <= budget, c).otherwise(F.concat(cut, F.lit(marker)))


def one_line(c: Column, limit: int = 120) -> Column:
    """White space collapsed, table bars escaped, cut to ``limit`` characters."""
    flat = F.regexp_replace(strip_ws(F.regexp_replace(empty(c), r"\s+", " ")), r"\|", r"\\|")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def canonical_remote(url: Column) -> Column:
    """host[:port]/path of a remote, without credentials, query or '.git'; '' for local ones."""
    s = F.regexp_replace(strip_ws(empty(url)), r"(?s)[?#].*$", "")
    local = s.rlike(r"^(?:file://|/|~|\./|\.\./|\\\\|[A-Za-z]:[\\/])") | s.isin("", ".", "..")
    web = s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?[^/@]+")
    host = F.when(web, F.regexp_extract(s, r"^[^:]+://(?:[^/@]*@)?([^/@]+)", 1)).otherwise(F.regexp_extract(s, r"^(?:[^:]*@)?([^:@]*):", 1))
    path = F.when(web, F.regexp_extract(s, r"^[^:]+://[^/]+(/.*)?$", 1)).otherwise(F.regexp_extract(s, r"^[^:]*:(.*)$", 1))
    for pattern in (r"^/", r"/$", r"\.git$", r"/$"):
        path = F.regexp_replace(path, pattern, "")
    got = F.concat_ws("/", F.lower(host), F.when(path != "", path))
    return F.when(local | (host == "") | (s.contains("://") & ~web), F.lit("")).otherwise(got)


def clean_model_output(c: Column) -> Column:
    """Reasoning blocks (unterminated ones drop the rest) and code fences go; the outermost object stays."""
    c = empty(c)
    c = F.when(c.contains("<think>"), F.regexp_replace(c, r"(?s)<think>.*?(?:</think>|\z)", "")).otherwise(c)
    # a fence has no braces, so it matters only where there is no object
    plain = F.regexp_replace(strip_ws(c), r"(?s)^```[a-zA-Z]*\s*\n?(.*?)\n?```$", "$1")
    return F.coalesce(F.regexp_substr(c, F.lit(r"(?s)\{.*\}")), strip_ws(plain))


def without_sections(c: Column, headers: tuple[str, ...]) -> Column:
    """Markdown without the named H1-H3 sections, each up to the next header of its level or higher."""
    lines = F.split(empty(c), "\n")
    names = "|".join(headers)
    zero = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc, line):
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
        hit = F.lower(line).rlike(rf"^#{{1,3}}\s+(?:{names})\s*$")
        ends = (level > 0) & (level <= acc["skip"])
        skip = F.when(hit & ((acc["skip"] == 0) | ends), level).when(ends, 0).otherwise(acc["skip"])
        return F.struct(skip.cast("int").alias("skip"), F.when(skip > 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"))

    return F.aggregate(lines, zero, step, lambda acc: F.array_join(acc["out"], "\n"))


# --- usage records -------------------------------------------------------------------------------


def _paths(*names: str) -> list[str]:
    return [f"$.{p}{n}" for n in names for p in ("usage.", "", "data.usage.")]


# Where providers put token counts, in order of preference.
_TOTAL = _paths("total_tokens")
_PROMPT = _paths("prompt_tokens", "input_tokens")
_COMPLETION = _paths("completion_tokens", "output_tokens")
_READ_OWN = _paths("cache_read_input_tokens")
_READ_IN = [f"$.{p}usage.{d}.cached_tokens" for d in ("prompt_tokens_details", "input_tokens_details") for p in ("", "data.")]
_WRITE_OWN = _paths("cache_creation_input_tokens")
_WRITE_IN = [f"$.{p}usage.prompt_tokens_details.cache_creation_tokens" for p in ("", "data.")]


def _first(body: Column, paths: list[str]) -> Column:
    # a body is parsed for each path, so only where the path's last name stands in it; with a backslash, the name may be written otherwise
    at = lambda p: F.when(body.contains(p.rpartition(".")[2]) | body.contains("\\"), F.get_json_object(body, p))
    return F.coalesce(*[at(p).try_cast("double") for p in paths], F.lit(None).cast("double")).cast("long")


def usage_tokens(body: Column) -> Column:
    """struct(total, prompt, completion, cache_read, cache_write), or null if nothing is reported.

    A missing total is prompt + completion, plus cache counts that stand beside the prompt's (those
    inside its details are part of it already).
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    total, prompt, completion = _first(body, _TOTAL), zero(_first(body, _PROMPT)), zero(_first(body, _COMPLETION))
    read, write = _first(body, _READ_OWN), _first(body, _WRITE_OWN)
    own = prompt + completion + zero(read) + zero(write)
    whole = F.when(zero(total) != 0, total).when((prompt > 0) | (completion > 0), own).otherwise(zero(total))
    return F.when(
        total.isNotNull() | (prompt != 0) | (completion != 0),
        F.struct(
            whole.alias("total"), prompt.alias("prompt"), completion.alias("completion"),
            zero(F.coalesce(read, _first(body, _READ_IN))).alias("cache_read"), zero(F.coalesce(write, _first(body, _WRITE_IN))).alias("cache_write"),
        ),
    )
