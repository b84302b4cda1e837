"""Which changed files are reviewed and why, and what their paths say."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.filetype import indexable
from tidemark.functions.globs import any_of, doublestar_regex, fnmatch_regex, gitignore_rules, index_glob_regex
from tidemark.functions.text import basename, byte_prefix, empty, extension, tokens_up

# Paths that are never reviewed.
SKIP = (
    "**/vendor/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/*.lock", "package-lock.json", "**/package-lock.json", "yarn.lock",
    "**/yarn.lock", "**/*.min.js", "**/*.min.css", "**/*.map", "**/.git/**", "**/__pycache__/**",
)
# Paths that are never indexed.
INDEX_SKIP = (
    "*.lock", "*.lockb", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "go.sum", "*.min.js", "*.min.css",
    "*.map", "*.svg", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.pdf", "*.zip", "*.tar.gz", "*.gz",
    "*.bz2", "*.exe", "*.dll", "*.so", "*.dylib", "node_modules/*", "vendor/*", ".git/*", "__pycache__/*", "dist/*", "build/*", ".next/*", ".nuxt/*",
)
# Folders that ignore rules always exclude.
ALWAYS_IGNORED = (".idea", ".vscode", ".svn", ".git", "vendor", "node_modules", "target", ".happypack", ".cachefile", "_packages", "rpm", "pkgs")
# Marks of generated files.
GENERATED = ("DO NOT EDIT", "AUTO-GENERATED", "AUTOGENERATED", "GENERATED BY", "AUTOMATICALLY GENERATED", "THIS FILE IS GENERATED", "@GENERATED")
# Path components by kind.
AUTH = (
    "auth", "authn", "authz", "session", "sessions", "token", "tokens", "crypto", "oauth", "oauth2", "jwt", "tls", "ssl", "permission",
    "permissions", "rbac", "acl", "iam", "keycloak",
)
MIGRATION = (
    "migration", "migrations", "migrate", "schema", "schemata", "sqlmigrate",
)
INFRA = (
    "dockerfile", "docker", "k8s", "kubernetes", "helm", "terraform", "ansible", "cloudformation", "pulumi",
)
# File names of tests.
TEST_NAME = r"(?i)(_test\.go|\.test\.(js|ts|jsx|tsx)|\.spec\.(js|ts)|_test\.py)$|^test_.*\.py$"


def effective_path() -> Column:
    """FLT-13: the new path, or the old one of a deletion."""
    return F.when((empty(F.col("new_path")) == "") | (F.col("new_path") == "/dev/null"), F.col("old_path")).otherwise(F.col("new_path"))


def is_pure_rename() -> Column:
    return F.col("is_renamed") & (F.col("insertions") == 0) & (F.col("deletions") == 0)


def matches(path: Column, patterns: Sequence[str]) -> Column:
    return path.rlike(any_of([doublestar_regex(p) for p in patterns]))


def fnmatch_excluded(path: Column, patterns: Sequence[str]) -> Column:
    """FLT-3: a pattern matches the path or its base name."""
    rx = any_of([fnmatch_regex(p) for p in patterns])
    return path.rlike(rx) | basename(path).rlike(rx)


def index_eligible(path: Column, extra: Sequence[str] = ()) -> Column:
    """FLT-4: an indexable extension and no skipped glob."""
    rx = any_of([index_glob_regex(p) for p in (*INDEX_SKIP, *extra)])
    return ~(path.rlike(rx) | basename(path).rlike(rx)) & indexable(basename(path))


def gitignored(path: Column, lines: Sequence[str] = ()) -> Column:
    """FLT-5: folders that are always ignored, then the last matching rule decides."""
    hit = path.rlike("^(?:.*/)?(?:" + "|".join(d.replace(".", r"\.") for d in ALWAYS_IGNORED) + ")/")
    state = F.lit(False)
    for rx, negated in gitignore_rules(list(lines)):
        state = F.when(path.rlike(rx), F.lit(not negated)).otherwise(state)
    return hit | state


def gitignored_by_repo(files: DataFrame, rules: DataFrame) -> DataFrame:
    """FLT-5 for many repositories: adds ``ignored`` to ``files`` (repo, path).

    ``rules``: repo, ord, line (the lines of each repository's ignore file). Lines become patterns once
    for each distinct line, in Python on the rule table; a repository's patterns travel as one
    array and the last that matches decides.
    """

    def run(batches):
        for pdf in batches:
            got = [(line, *r[0]) for line in pdf["line"] if (r := gitignore_rules([line or ""]))]
            yield pd.DataFrame(got, columns=["line", "rx", "negated"])

    each = rules.select("line").distinct().mapInPandas(run, "line string, rx string, negated boolean")
    item = F.struct("ord", "rx", "negated")
    own = rules.join(each.hint("merge"), "line").groupBy("repo").agg(F.array_sort(F.collect_list(item)).alias("patterns"))
    hit = F.aggregate(F.coalesce("patterns", F.array().cast(own.schema["patterns"].dataType)), F.lit(False), lambda acc, p: F.when(F.rlike(F.col("path"), p["rx"]), ~p["negated"]).otherwise(acc))
    return files.join(own.hint("merge"), "repo", "left").withColumn("ignored", gitignored(F.col("path")) | hit).drop("patterns")


def is_generated(content: Column) -> Column:
    """FLT-6: a mark in the first 1000 bytes."""
    return F.upper(byte_prefix(empty(content), 1000)).rlike("|".join(GENERATED))


def select_changes(
    changes: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = (), exclude_deleted: bool = True, max_tokens: int = 12_000
) -> DataFrame:
    """FLT-1: one decision a change: reason ('' if included) and included."""
    path = effective_path()
    reason = F.when(F.col("is_binary"), "binary")
    if exclude_deleted:
        reason = reason.when(F.col("is_deleted"), "deleted")
    if exclude:
        reason = reason.when(matches(path, exclude), "user_exclude")
    if include:
        reason = reason.when(~matches(path, include), "not_allowed")
    else:
        reason = reason.when(~indexable(path), "extension").when(matches(path, SKIP), "default_pattern")
    if max_tokens > 0:
        reason = reason.when(tokens_up(F.col("diff")) > max_tokens, "too_large")
    return changes.withColumn("reason", reason.otherwise("")).withColumn("included", F.col("reason") == "")


def decision_summary(decisions: DataFrame) -> DataFrame:
    """AGG-2."""
    return decisions.groupBy("reason").agg(F.count("*").alias("n"))


def _component(path: Column, words: Sequence[str]) -> Column:
    parts = F.transform(F.split(F.lower(path), "/"), lambda p: F.substring(p, F.lit(1), F.length(p) - F.length(extension(p))))
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))


def touches_auth(path: Column) -> Column:
    return _component(path, AUTH)


def touches_migration(path: Column) -> Column:
    return _component(path, MIGRATION) | (F.lower(extension(path)) == ".sql")


def touches_infra(path: Column) -> Column:
    return F.lower(basename(path)).rlike(r"^dockerfile(\.|$)") | _component(path, INFRA)


def is_test_file(path: Column) -> Column:
    return basename(path).rlike(TEST_NAME) | F.lower(path).rlike(r"(^|/)(test|tests|__tests__|spec)/")


def non_reviewable(path: Column) -> Column:
    """FLT-12."""
    return F.lower(path).rlike(r"(^|/)(\.claude|vendor|node_modules)/")


def size_class(content: Column, trivial: int = 600, large: int = 5000) -> Column:
    """FLT-20."""
    n = F.octet_length(empty(content))
    return F.when(n < trivial, "trivial").when(n >= large, "large").otherwise("normal")


def chore_class(decisions: DataFrame) -> DataFrame:
    """FLT-22: 'docs' for change sets with documents only, else 'chore', where nothing is reviewed."""
    doc = F.lower(effective_path()).rlike(r"\.(md|mdx|rst|txt|adoc)$|(^|/)docs?/")
    g = decisions.groupBy("owner", "repo", "pr").agg(F.bool_or("included").alias("any"), F.bool_and(doc).alias("docs"))
    return g.where("not any").select("owner", "repo", "pr", F.when(F.col("docs"), "docs").otherwise("chore").alias("pr_type"))
