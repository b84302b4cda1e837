"""Symbols and imports of source files, found line by line in nine languages, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.filetype import language
from tidemark.functions.text import strip_ws

_PARAMS = r"\s*(\([^)]*\))?"


def _rule(kind: str | None, keyword: str, words: str = "", indent: str = r"\s*", params: str = "()") -> tuple[str | None, str]:
    """A declaration by keyword: modifiers in any order, keyword, name. Without a ``kind``, the keyword is the kind.

    Each rule has three groups: a word (the kind, or Go's receiver), the name, the parameters.
    """
    before = rf"(?:(?:{words})\s+)*" if words else ""
    return kind, f"{indent}{before}{f'({keyword})' if kind is None else f'(?:{keyword})()'}\\s+(\\w+){params}"


def _assigned(kind: str, keyword: str, value: str = "") -> tuple[str, str]:
    return kind, rf"\s*(?:export\s+)?(?:{keyword})\s+()(\w+)\s*={value}()"


# What a line of a language declares. The first rule that matches decides.
_SCRIPT = [
    _rule("class", "class", "export|default"),
    _rule("function", "function", "export|default|async", params=_PARAMS),
    _assigned("function", "const|let|var", r"\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>"),
    _assigned("constant", "const"),
    _assigned("variable", "let|var"),
]
_TEMPLATE = r"\s*(?:template\s*<[^>]*>\s*)?"
_CPP = [
    _rule("class", "class", indent=_TEMPLATE),
    _rule("struct", "struct", indent=_TEMPLATE),
    ("function", r"\s*(?:(?:inline|static|virtual|explicit|constexpr|extern|friend)\s+)*()(?:\w+(?:::\w+)*(?:\s*<[^>]*>)?[*&\s]+)+(\w+)()\s*\([^;]*\)\s*(?:const\s*)?(?:\{|$)"),
]
_RUST_WORDS = r"pub(?:\([^)]*\))?"
RULES: dict[str, list[tuple[str | None, str]]] = {
    "python": [
        _rule("method", "def", "async", indent=r"\s+", params=_PARAMS),
        _rule("function", "def", "async", indent="", params=_PARAMS),
        _rule("class", "class"),
    ],
    "javascript": _SCRIPT,
    "typescript": [
        *_SCRIPT,
        _rule("interface", "interface", "export|default"),
        _rule("type", "type", "export"),
        _rule("enum", "enum", "export|const"),
    ],
    "ruby": [("function", r"\s*def\s+()(?:self\.)?(\w+)" + _PARAMS), _rule("class", "class"), _rule("module", "module")],
    "rust": [
        _rule("function", "fn", _RUST_WORDS + r'|async|unsafe|extern\s+"[^"]+"', params=r"\s*(?:<[^>]*>)?" + _PARAMS),
        _rule("struct", "struct", _RUST_WORDS),
        _rule("enum", "enum", _RUST_WORDS),
        _rule("trait", "trait", _RUST_WORDS + "|unsafe"),
        ("type", r"\s*impl(?:<[^>]*>)?\s+()(?:.+\s+for\s+)?(\w+)()"),
    ],
    "java": [
        _rule(None, "class|interface|enum", "public|private|protected|static|abstract|final|sealed|non-sealed|strictfp"),
        _rule("class", "record", "public|private|protected|static|abstract|final|sealed|non-sealed|strictfp"),
        _rule("method", r"\w+(?:<[^>]*>)?(?:\[\])*", "public|private|protected|static|final|synchronized|abstract|native|default", params=r"()\s*\("),
    ],
    "cpp": _CPP,
    "c": _CPP,
    "go": [
        ("method", r"func\s+\(([^)]+)\)\s+(\w+)\s*(\([^)]*\))"),
        ("function", r"func()\s+(\w+)\s*(\([^)]*\))"),
        (None, r"type\s+(?=\w+\s+(struct|interface)\b)(\w+)()"),
        ("constant", r"const\s+()(\w+)()"),
        ("variable", r"var\s+()(\w+)()"),
        ("type", r"type\s+()(\w+)()\s+"),
    ],
}
#: Names that a rule may take for a function although they are keywords.
RESERVED = {
    "java": ("if", "for", "while", "switch", "return", "catch", "synchronized", "throw", "new"),
    "cpp": ("if", "for", "while", "switch", "return", "sizeof", "operator", "new", "delete"),
}
RESERVED["c"] = RESERVED["cpp"]

_DQ, _SQ, _BQ = r'"(?:\\.|[^"\\])*+(?:"|$)', r"'(?:\\.|[^'\\])*+(?:'|$)", r"`(?:\\.|[^`\\])*+(?:`|$)"
_SLASHES = rf"^((?:\\.|{_DQ}|{_SQ}|{_BQ}|/(?!/)|[^\"'`/\\])*+)//.*$"
_HASH = rf"^((?:\\.|{_DQ}|{_SQ}|[^\"'#\\])*+)#.*$"
#: Go: strings and runes stay, comments and raw strings become blanks (with a line feed if they held one).
_GO_NOISE = (
    r'("(?:\\[^\n]|[^"\\\n])*+(?:\\?"|(?=\n|\z))|' r"'(?:\\[^\n]|[^'\\\n])*+(?:'|(?=\n|\z)))"
    r"|//[^\n]*|/\*(?:(?!\*/)[^\n])*+(\n)?(?:(?!\*/)[\s\S])*+(?:\*/|\z)|`[^`\n]*+(\n)?[^`]*+(?:`|\z)"
)


#: A Go block (its opening line and all lines before the closing one), or one line.
_GO_BLOCK = (
    r"[^\S\n]*(?:import \([^)\n]*|(?:const|var|type)[^\S\n]*\([^\S\n]*)(?:\n|\z)(?:(?![^\S\n]*\))(?:[^\n]*\n|[^\n]+\z))*+"
    r"|[^\n]*\n?"
)
#: Marks between what a line's rules found: before all, between rules, between a rule's groups.
_FOUND, _NEXT, _GROUP = "\x01", "\x02", "\x03"


def _by_language(cases: dict[str, Column]) -> Column:
    out = None
    for lang, c in cases.items():
        out = F.when(F.col("lang") == lang, c) if out is None else out.when(F.col("lang") == lang, c)
    return out


def code_lines(files: DataFrame) -> DataFrame:
    """repo, path, lang, pos, raw, line (without comments), within, found of the files (repo, path, content) in known languages.

    ``within``: the kind of Go's open 'import (', 'const (', 'var (' or 'type (' block, else empty. ``found``: what the
    rules of the language find in the line, all of them as one alternation, so a line is matched once. A Go text
    is cut into blocks and lines by one pattern; nothing is shuffled.
    """
    d = files.withColumn("lang", language(F.col("path"))).where(F.col("lang").isin(*RULES))
    go = F.col("lang") == "go"
    chop = lambda x: F.regexp_replace(x, r"\n\z", "")
    kind = lambda block: F.when(block.contains("\n"), F.regexp_extract(block, r"^[^\S\n]*(import|const|var|type)\s*\(", 1)).otherwise("")
    line_of = lambda block: lambda x, k: F.struct(x.alias("raw"), F.when(k > 0, kind(block)).otherwise("").alias("within"))
    blocks = F.regexp_extract_all(F.regexp_replace("content", _GO_NOISE, "$1$2$3 "), F.lit(_GO_BLOCK), F.lit(0))
    in_blocks = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(chop(b), "\n"), line_of(b))))
    plain = F.transform(F.split("content", "\n"), lambda x: F.struct(x.alias("raw"), F.lit("").alias("within")))
    # outer: else the plan tests the size of the array first, which computes it twice
    d = d.select("repo", "path", "lang", F.posexplode_outer(F.when(go, in_blocks).otherwise(plain)).alias("pos", "l")).where("pos is not null")
    d = d.select("repo", "path", "lang", "pos", "l.raw", "l.within")
    hashed = F.col("lang").isin("python", "ruby")
    # most lines have no comment, which a plain search tells
    noted = F.when(hashed, F.col("raw").contains("#")).otherwise(F.col("raw").contains("//"))
    line = F.when(go | ~noted, F.col("raw")).when(hashed, F.regexp_replace("raw", _HASH, "$1")).otherwise(F.regexp_replace("raw", _SLASHES, "$1"))
    d = d.withColumn("line", line)
    found = {}
    for lang, rules in RULES.items():
        groups = _NEXT.join(_GROUP.join(f"${3 * k + g}" for g in (1, 2, 3)) for k in range(len(rules)))
        found[lang] = F.regexp_replace("line", f"^(?:{'|'.join(rx for _, rx in rules)})[\\s\\S]*$", _FOUND + groups)
    found = F.when(F.col("within") == "", _by_language(found))
    return d.withColumn("found", found).withColumn("found", F.when(F.col("found").startswith(_FOUND), F.substring("found", 2, 1 << 30)))


def _declared() -> Column:
    """What a line declares: an array of one struct(name, kind, signature), or empty."""
    kinds = F.create_map(*[x for lang, rules in RULES.items() for x in (F.lit(lang), F.array(*[F.lit(k or "") for k, _ in rules]))])
    each = F.transform(F.split("found", _NEXT), lambda x, k: F.struct(k.alias("rule"), F.split(x, _GROUP).alias("g")))
    first = F.slice(F.filter(each, lambda x: x["g"][1] != ""), 1, 1)
    known = F.transform(first, lambda h: F.struct(F.get(F.try_element_at(kinds, F.col("lang")), h["rule"]).alias("kind"), h["g"].alias("g")))

    def allowed(h: Column) -> Column:
        names = [~((F.col("lang") == lang) & h["g"][1].isin(*words)) for lang, words in RESERVED.items()]
        return ~h["kind"].isin("method", "function") | (names[0] & names[1] & names[2])

    def told(h: Column) -> Column:
        word, name, params = (h["g"][i] for i in range(3))
        receiver = F.when((F.col("lang") == "go") & (h["kind"] == "method"), F.concat(F.lit("("), strip_ws(word), F.lit(") "))).otherwise("")
        return F.struct(name.alias("name"), F.when(h["kind"] == "", word).otherwise(h["kind"]).alias("kind"), F.concat(receiver, name, params).alias("signature"))

    item = F.filter(F.array(F.regexp_extract("line", r"^\s*(\w+)\b", 1)), lambda x: x != "")
    block = F.create_map(*[F.lit(x) for x in ("const", "constant", "var", "variable", "type", "type")])
    inside = F.transform(item, lambda x: F.struct(x.alias("name"), F.try_element_at(block, F.col("within")).alias("kind"), x.alias("signature")))
    none = F.array().cast("array<struct<name:string,kind:string,signature:string>>")
    return F.when(F.col("within") == "import", none).when(F.col("within") != "", inside).when(F.col("found").isNotNull(), F.transform(F.filter(known, allowed), told)).otherwise(none)


def symbols(lines: DataFrame) -> DataFrame:
    """EXT-1: repo, path, ord, name, kind, signature of the declarations in :func:`code_lines`."""
    got = lines.select("repo", "path", "pos", F.explode_outer(_declared()).alias("s")).where("s is not null")
    return got.select("repo", "path", F.col("pos").alias("ord"), "s.name", "s.kind", "s.signature")


def _rust_paths(clause: Column) -> Column:
    """The paths of a 'use' clause: 'a::{b, c::{d, self}}' gives a::b, a::c::d, a::c. Braces nest to any depth.

    The clause's pieces are folded with a stack of the heads of open braces.
    """
    join = lambda head, item: F.concat_ws("::", F.nullif(head, F.lit("")), F.nullif(item, F.lit("")))
    pieces = F.regexp_extract_all(clause, F.lit(r"[{},]|[^{},]+"), F.lit(0))
    state = lambda stack, item, out: F.struct(stack.alias("stack"), item.alias("item"), out.alias("out"))
    blank, strings = F.lit(""), F.array().cast("array<string>")

    def emitted(s: Column) -> Column:
        head = F.element_at(s["stack"], -1)
        path = F.when((s["item"] == "self") & (head != ""), head).otherwise(join(head, s["item"]))
        return F.when(s["item"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(path)))

    def step(s: Column, piece: Column) -> Column:
        opened = F.concat(s["stack"], F.array(join(F.element_at(s["stack"], -1), F.regexp_replace(s["item"], "::$", ""))))
        closed = F.when(F.size(s["stack"]) > 1, F.slice(s["stack"], 1, F.size(s["stack"]) - 1)).otherwise(s["stack"])
        return (
            F.when(piece == "{", state(opened, blank, s["out"]))
            .when(piece == "}", state(closed, blank, emitted(s)))
            .when(piece == ",", state(s["stack"], blank, emitted(s)))
            .otherwise(state(s["stack"], strip_ws(piece), s["out"]))
        )

    return F.aggregate(pieces, state(F.array(blank), blank, strings), step, emitted)


_USE = r"^\s*(?:pub\s+)?use\s+([^;]+);"


def _trimmed_path(p: Column) -> Column:
    return strip_ws(F.regexp_replace(F.regexp_replace(p, r"\s+as\s.*$", ""), r"::\*$", ""))


def _imported(lang: str) -> Column:
    """The raw imports of a line as an array."""
    line = F.col("line")
    one = lambda rx, g=1: F.when(line.rlike(rx), F.array(F.regexp_extract(line, rx, g)))
    names = lambda s: F.filter(
        F.transform(F.split(s, ","), lambda n: strip_ws(F.regexp_replace(F.regexp_replace(strip_ws(n), r" as .*$", ""), r"^[()]+|[()]+$", ""))),
        lambda n: (n != "") & (n != "*"),
    )
    none = F.array().cast("array<string>")
    if lang == "python":
        rx = r"^\s*from\s+([\w.]+)\s+import\s+(.+)$"
        base, plain = F.regexp_extract(line, rx, 1), r"^\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)"
        inner = F.transform(names(F.regexp_extract(line, rx, 2)), lambda n: F.concat(base, F.lit("."), n))
        return F.when(line.rlike(rx), F.concat(inner, F.array(base))).when(line.rlike(plain), names(F.regexp_extract(line, plain, 1)))
    if lang in ("javascript", "typescript"):
        bare = F.regexp_replace(line, rf"{_DQ}|{_SQ}|{_BQ}", " ")
        static, dynamic = r"""^\s*import\b[^'"\n]*['"]([^'"]+)['"]""", r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)"""
        both = F.concat(F.coalesce(one(static), none), F.coalesce(one(dynamic), none))
        has = lambda word: line.contains(word) & bare.contains(word)
        required = one(r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
        return F.concat(F.when(has("import"), both).otherwise(none), F.coalesce(F.when(has("require"), required), none))
    if lang == "rust":
        clause = strip_ws(F.regexp_extract(line, _USE, 1))
        return F.when(line.rlike(_USE), F.filter(F.transform(_rust_paths(clause), _trimmed_path), lambda p: p != ""))
    if lang == "go":
        inner = r'^\s*(?:(?:[A-Za-z_]\w*|_|\.)\s+)?"([^"]+)"\s*$'
        block = F.transform(F.regexp_extract_all(line, F.lit(r'"([^"]+)"')), lambda x: x)
        return F.when(F.col("within") == "import", one(inner)).when((F.col("within") == "") & line.rlike(r"^import \(.*\)"), block).when(
            F.col("within") == "", one(r'^import\s+(?:(?:[A-Za-z_]\w*|_|\.)\s+)?"([^"]+)"\s*$')
        )
    if lang == "ruby":
        return one(r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""")
    if lang == "java":
        return one(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;")
    return one(r'^\s*#\s*include\s*"([^"]+)"')


def imports(lines: DataFrame) -> DataFrame:
    """EXT-1: repo, path, lang, ord, nth, import: each raw import of a file once, at its first place (SET-4).

    Lines that declare something import nothing, but for constants and variables of JavaScript and
    TypeScript, which may hold a require().
    """
    script = F.col("lang").isin("javascript", "typescript") & F.col("s.kind").isin("constant", "variable", "interface", "type", "enum")
    likely = (F.col("within") == "import") | F.col("line").rlike(r"import|require|include|use\s")
    # a line begins its raw line, so this loses none; the others are left before they are matched
    lines = lines.where((F.col("within") == "import") | F.col("raw").rlike(r"import|require|include|use\s"))
    d = lines.withColumn("s", F.when(likely, F.get(_declared(), 0))).withColumn("likely", likely)
    open_ = F.col("likely") & (F.col("s").isNull() | script | (F.col("lang") == "rust"))
    got = F.when(open_, _by_language({lang: _imported(lang) for lang in RULES}))
    d = d.select("repo", "path", "lang", "pos", F.posexplode_outer(got).alias("k", "import")).where("k is not null")
    # one number, which a hash aggregation takes; a struct is sorted
    at = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("k")
    first = d.groupBy("repo", "path", "lang", "import").agg(F.min(at).alias("at"))
    return first.select("repo", "path", "lang", F.shiftright("at", 32).cast("int").alias("ord"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("nth"), "import")
