"""Language of a path by its extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import extension

# Extensions by language.
LANGUAGES = {
    "python": ("py",),
    "javascript": ("js", "jsx"),
    "typescript": ("ts", "tsx"),
    "ruby": ("rb",),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "csharp": ("cs",),
    "cpp": ("cpp", "cc", "hpp"),
    "c": ("c", "h"),
    "swift": ("swift",),
    "php": ("php",),
    "scala": ("scala",),
    "bash": ("sh", "bash"),
    "zsh": ("zsh",),
    "yaml": ("yml", "yaml"),
    "json": ("json",),
    "toml": ("toml",),
    "xml": ("xml",),
    "html": ("html",),
    "css": ("css",),
    "scss": ("scss",),
    "sql": ("sql",),
    "markdown": ("md",),
    "r": ("r",),
    "dart": ("dart",),
    "lua": ("lua",),
    "elixir": ("ex", "exs"),
    "erlang": ("erl",),
    "haskell": ("hs",),
    "ocaml": ("ml",),
    "clojure": ("clj",),
    "vim": ("vim",),
    "terraform": ("tf",),
    "graphql": ("graphql",),
    "protobuf": ("proto",),
}
# Languages that are indexed.
INDEXABLE = (
    "python", "javascript", "typescript", "ruby", "go", "rust", "java", "kotlin", "csharp", "cpp", "c", "swift", "php", "scala", "bash", "zsh",
    "yaml", "json", "toml", "sql", "lua", "terraform", "graphql", "protobuf",
)

BY_EXTENSION = {f".{e}": lang for lang, es in LANGUAGES.items() for e in es}


def language(path: Column) -> Column:
    """Language of the path's last suffix; '' if unknown."""
    table = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(extension(path))), F.lit(""))


def indexable(path: Column) -> Column:
    return language(path).isin(*INDEXABLE)


def sql_language(path: str) -> str:
    """The same in DuckDB SQL."""
    whens = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in BY_EXTENSION.items())
    return f"CASE lower(regexp_extract({path}, '(\\.[^./]*)$', 1)) {whens} ELSE '' END"
