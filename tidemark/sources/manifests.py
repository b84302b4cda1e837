"""Dependencies declared in package manifests and lock files, as one table for all repositories."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_ws

# Groups of optional dependencies that count as development ones.
DEV_GROUPS = ("dev", "test", "testing", "lint", "docs")
# File names by format.
NAMES = {
    "uv.lock": "toml_lock", "poetry.lock": "toml_lock", "Pipfile.lock": "pipfile_lock", "composer.lock": "composer_lock",
    "package-lock.json": "package_lock", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package.json": "package_json",
    "pyproject.toml": "pyproject", "go.mod": "go_mod", "composer.json": "composer_json", "Dockerfile": "dockerfile", "dockerfile": "dockerfile",
    "Containerfile": "dockerfile",
}

_EXTRAS = r"\[[^\]]*\]"
_NAME = r"[A-Za-z0-9][A-Za-z0-9\-_.]*"


def manifest_format(path: Column) -> Column:
    """The format of a manifest by its base name; null for other files."""
    base = F.substring_index(path, "/", -1)
    known = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    listed = base.startswith("requirements") & base.rlike(r"^requirements.*\.txt$")
    return F.when(listed, "requirements").when(base.endswith(".Dockerfile"), "dockerfile").otherwise(F.try_element_at(known, base))


def _item(name: Column, version: Column, dev: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), dev.alias("is_dev"))


def _text_entries(block: Column, dev: bool) -> Column:
    """Entries of a map whose values are strings (others are skipped)."""
    kept = F.filter(F.map_entries(block), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    return F.transform(kept, lambda e: _item(e["key"], F.variant_get(e["value"], "$", "string"), F.lit(dev)))


def _structs(block: Column, dev: bool) -> Column:
    return F.transform(F.map_entries(block), lambda e: _item(e["key"], e["value"]["version"], F.lit(dev)))


def _many(*lists: Column) -> Column:
    none = F.array().cast("array<struct<name:string,version:string,is_dev:boolean>>")
    return F.concat(*[F.coalesce(x, none) for x in lists])


_VERSIONS = "map<string, struct<version: string>>"
_LISTED = "array<struct<name: string, version: string>>"
_TEXTS = "map<string, variant>"
#: What is read of the JSON formats.
JSON_SCHEMAS = {
    "package_json": f"dependencies {_TEXTS}, devDependencies {_TEXTS}, peerDependencies {_TEXTS}, optionalDependencies {_TEXTS}",
    "package_lock": f"packages map<string, struct<version: string, dev: boolean>>, dependencies {_VERSIONS}",
    "pipfile_lock": f"default {_VERSIONS}, develop {_VERSIONS}",
    "composer_json": f"require {_TEXTS}, `require-dev` {_TEXTS}",
    "composer_lock": f"packages {_LISTED}, `packages-dev` {_LISTED}",
}


def _json_items(j: Column, form: str) -> Column:
    """The packages of a parsed text."""
    if form == "package_json":
        items = _many(*[_text_entries(j[b], b == "devDependencies") for b in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])
    elif form == "package_lock":
        tail = lambda k: F.regexp_extract(k, r"(?s)^(?:.*node_modules/)?(.*)$", 1)
        name = lambda k: F.regexp_extract(tail(k), r"^(@[^/]*/[^/]*|[^@/][^/]*)", 1)
        flat = F.filter(F.map_entries(j["packages"]), lambda e: e["key"] != "")
        flat = F.transform(flat, lambda e: _item(name(e["key"]), e["value"]["version"], F.coalesce(e["value"]["dev"], F.lit(False))))
        items = F.when(F.size(j["packages"]) > 0, _many(flat)).otherwise(_many(_structs(j["dependencies"], False)))
    elif form == "pipfile_lock":
        items = _many(_structs(j["default"], False), _structs(j["develop"], True))
    elif form == "composer_json":  # names without a vendor are platform packages
        items = F.filter(_many(_text_entries(j["require"], False), _text_entries(j["require-dev"], True)), lambda x: x["name"].contains("/"))
    else:
        each = lambda block, dev: F.transform(block, lambda e: _item(e["name"], e["version"], F.lit(dev)))
        items = _many(each(j["packages"], False), each(j["packages-dev"], True))
    return F.transform(items, lambda i: _item(i["name"], strip_ws(i["version"]), i["is_dev"]))


def _text_lines(content: Column) -> Column:
    """The lines of a text, without a carriage return."""
    return F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))


def _code(line: Column) -> Column:
    """A line of go.mod without its comment."""
    return strip_ws(F.regexp_replace(line, "//.*$", ""))


def _kept_lines(content: Column, form: Column) -> Column:
    """What the formats of lines keep of each line."""
    every = _text_lines(content)
    asked = F.filter(F.transform(every, strip_ws), lambda x: ~x.rlike(r"^($|[#\-./])"))
    specs = F.transform(asked, lambda x: F.regexp_replace(strip_ws(F.regexp_replace(x, "#.*$", "")), _EXTRAS, ""))
    images = F.transform(every, lambda x: F.regexp_extract(x, r"(?i)^\s*FROM\s+(\S+)(?:\s+AS\s+\S+)?\s*$", 1))
    filled = F.filter(every, lambda x: (x != "") & ~x.rlike(r"^\s*#"))
    return F.when(form == "requirements", specs).when(form == "dockerfile", images).when(form.isin("yarn", "pnpm"), filled).when(form == "go_mod", every)


def _yarn_head(line: Column) -> Column:
    return line.rlike(r"^[^ \t].*:$")


def _starts(lines: Column, form: Column) -> Column:
    """Where blocks of yarn, sections of pnpm and brackets of go.mod begin or end: indexes of ``lines``."""
    at = lambda test: F.array_compact(F.transform(lines, lambda x, i: F.when(test(x), i)))
    bracket = lambda x: _code(x).rlike(r"^(?:\w+\s*\(|\))$")
    return F.when(form == "yarn", at(_yarn_head)).when(form == "pnpm", at(lambda x: x.rlike(r"^[^ \t]"))).when(form == "go_mod", at(bracket))


def _runs(lines: Column, starts: Column) -> Column:
    """The parts of ``lines`` that begin at ``starts``, each up to the next. Both must be columns that exist: they are read for each part."""
    return F.transform(starts, lambda p, k: F.slice(lines, p + 1, F.coalesce(F.try_element_at(starts, k + 2), F.size(lines)) - p))


def _requirements(specs: Column, path: Column) -> Column:
    rx = rf"^({_NAME})\s*((?:[=<>!~]=?|===)?)\s*([^;#\s]*)"
    part = lambda x, k: F.regexp_extract(x, rx, k)
    dev = F.lower(path).rlike("dev|test")
    return F.transform(specs, lambda x: _item(part(x, 1), F.when(part(x, 3) != "", F.concat(part(x, 2), part(x, 3))).otherwise(""), dev))


def _yarn(lines: Column, starts: Column) -> Column:
    """A block's name comes from its header's first specifier, its version from the first version line below."""
    name = lambda x: F.regexp_extract(F.regexp_replace(strip_ws(F.regexp_extract(x, r"^([^,]*?)(?:,.*)?:$", 1)), r'^"+|"+$', ""), r"^(@?[^@]*)", 1)
    version = lambda x: F.regexp_replace(strip_ws(F.regexp_extract(strip_ws(x), r"^version[ \t]\s*(.*)$", 1)), r'^"+|"+$', "")
    hits = lambda b: F.filter(b, lambda x, i: (i > 0) & strip_ws(x).rlike(r"^version[ \t]"))
    return F.transform(_runs(lines, starts), lambda b: _item(name(F.get(b, F.lit(0))), version(F.get(hits(b), F.lit(0))), F.lit(False)))


def _pnpm(lines: Column, starts: Column) -> Column:
    """Keys '/name@version' or '/name/version' of the section 'packages:'; what peers add in brackets is dropped."""
    sections = F.filter(_runs(lines, starts), lambda b: F.get(b, F.lit(0)).startswith("packages:"))
    keys = F.flatten(F.transform(sections, lambda b: F.slice(b, F.lit(2), F.size(b))))
    specs = F.transform(keys, lambda x: F.regexp_extract(strip_ws(x), r"""^/([^(]*?)(?:\(.*)?['"]*:$""", 1))
    modern = r"^(@[^@]+|[^@]+)@(.*)$"
    old = r"^(@[^/]*/[^/]*|[^@/][^/]*)/(.*)$"
    part = lambda x, k: F.when(x.rlike(modern), F.regexp_extract(x, modern, k)).otherwise(F.regexp_extract(x, old, k))
    return F.transform(F.filter(specs, lambda x: x != ""), lambda x: _item(part(x, 1), part(x, 2), F.lit(False)))


def _dockerfile(images: Column) -> Column:
    tagged = r"^([^$].*):([^:]*)$"
    part = lambda x, k, other: F.when(x.rlike(tagged), F.regexp_extract(x, tagged, k)).otherwise(other)
    return F.transform(F.filter(images, lambda x: x != ""), lambda x: _item(part(x, 1, x), part(x, 2, F.lit("")), F.lit(False)))


def _go_mod(lines: Column, starts: Column) -> Column:
    """Lines 'require path version' and those of 'require (' blocks; indirect ones count as development."""
    rx = r'^(?:require\s+)?"?([^\s"()]+)"?\s+"?(v[^\s"()]+)"?$'
    runs = _runs(lines, starts)
    required = lambda b: _code(F.get(b, F.lit(0))).rlike(r"^require\s*\($")
    before = F.slice(lines, F.lit(1), F.coalesce(F.get(starts, F.lit(0)), F.size(lines)))
    outside = F.concat(before, F.flatten(F.filter(runs, lambda b: ~required(b))))
    alone = F.filter(outside, lambda x: _code(x).rlike(r"^require\s+[^(]"))
    kept = F.filter(F.concat(alone, F.flatten(F.filter(runs, required))), lambda x: _code(x).rlike(rx))
    return F.transform(kept, lambda x: _item(F.regexp_extract(_code(x), rx, 1), F.regexp_extract(_code(x), rx, 2), x.rlike(r"//\s*indirect\b")))


def _toml_declared(form: str, content: str) -> Iterator[tuple[str, str | None, bool]]:
    """(name, version, is_dev); the version of a requirement line is null: the line is the name."""
    t = tomllib.loads(content)
    if form == "toml_lock":
        yield from ((p.get("name", ""), p.get("version", ""), False) for p in t.get("package", []) if p.get("version"))
        return
    project, poetry = t.get("project", {}), t.get("tool", {}).get("poetry", {})
    yield from ((line, None, False) for line in project.get("dependencies", []))
    for group, lines in project.get("optional-dependencies", {}).items():
        yield from ((line, None, group.lower() in DEV_GROUPS) for line in lines)
    groups = [(poetry.get("dependencies", {}), False), (poetry.get("dev-dependencies", {}), True)]
    groups += [(g.get("dependencies", {}), name.lower() in DEV_GROUPS) for name, g in poetry.get("group", {}).items()]
    for k, (block, dev) in enumerate(groups):
        for name, v in block.items():
            if k or name != "python":
                v = v.get("version", "") if isinstance(v, dict) else v
                yield name, v if isinstance(v, str) else "", dev


def _toml(form: Column, content: Column) -> Column:
    """The TOML formats as raw declarations, by the standard library: Spark has no TOML reader.

    Files that don't parse, or whose names or versions are no strings, have none.
    """

    @F.arrow_udf("array<struct<declared: string, version: string, is_dev: boolean>>")
    def declared(forms: pa.Array, contents: pa.Array) -> pa.Array:
        ends, names, versions, devs = [0], [], [], []
        for form, content in zip(forms.to_pylist(), contents.to_pylist(), strict=True):
            if content is not None:
                try:
                    for name, version, dev in (got := list(_toml_declared(form, content))):
                        if not isinstance(name, str) or not isinstance(version, str | None):
                            raise TypeError("no string")
                except (tomllib.TOMLDecodeError, AttributeError, TypeError):  # a file that is no such manifest is left out
                    got = []
                for name, version, dev in got:
                    names.append(name)
                    versions.append(version)
                    devs.append(dev)
            ends.append(len(names))
        fields = [pa.array(names, pa.string()), pa.array(versions, pa.string()), pa.array(devs, pa.bool_())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["declared", "version", "is_dev"]))

    toml = form.isin("toml_lock", "pyproject")
    return declared(F.when(toml, form), F.when(toml, content))


def _toml_items(declared: Column) -> Column:
    rx = rf"(?s)^({_NAME})\s*(.*)$"
    spec = lambda x: F.regexp_replace(strip_ws(F.regexp_replace(x["declared"], "(?s);.*$", "")), _EXTRAS, "")
    line = lambda x: _item(F.regexp_extract(spec(x), rx, 1), strip_ws(F.regexp_extract(spec(x), rx, 2)), x["is_dev"])
    return F.transform(declared, lambda x: F.when(x["version"].isNull(), line(x)).otherwise(_item(x["declared"], x["version"], x["is_dev"])))


#: Kind of package by format.
KINDS = {
    "toml_lock": "pip", "pipfile_lock": "pip", "requirements": "pip", "pyproject": "pip", "composer_lock": "composer", "composer_json": "composer",
    "package_lock": "npm", "pnpm": "npm", "yarn": "npm", "package_json": "npm", "go_mod": "go", "dockerfile": "docker",
}


#: Formats whose entries without a version don't count.
VERSIONED = ("package_lock", "pipfile_lock", "composer_lock", "yarn", "pnpm")


def packages(files: DataFrame) -> DataFrame:
    """SRC-9: repo, name, kind, version, file_path, is_dev of all manifests among ``files`` (repo, path, content).

    The base name decides the format; a file that doesn't parse gives no rows; blank names go.
    The input is read once, nothing is written or shuffled: a manifest becomes the array of its packages within its row, so
    files that are partitioned by (repo, path) stay so, and a DISTINCT of the packages needs no shuffle either.
    """
    form, content, path, lines, starts = (F.col(c) for c in ("form", "content", "path", "lines", "starts"))
    d = files.select("repo", "path", "content", manifest_format(path).alias("form")).where("form is not null")
    strict = {"allowNonNumericNumbers": "false"}
    parsed = [F.from_json(F.when(form == f, content), f"{schema}, _corrupt_record string", strict).alias(f) for f, schema in JSON_SCHEMAS.items()]
    d = d.select("repo", "path", "form", *parsed, _toml(form, content).alias("toml"), _kept_lines(content, form).alias("lines"))
    d = d.withColumn("starts", _starts(lines, form))
    items = F.when(form.isin("toml_lock", "pyproject"), _toml_items(F.col("toml")))
    for f in JSON_SCHEMAS:
        # what the schema can't take is kept as text too; a text is parsed again only then, to tell other types from no JSON
        odd = F.col(f)["_corrupt_record"]
        items = items.when(form == f, F.when(odd.isNull() | F.get_json_object(odd, "$").isNotNull(), _json_items(F.col(f), f)))
    items = items.when(form == "requirements", _requirements(lines, path)).when(form == "dockerfile", _dockerfile(lines))
    items = items.when(form == "yarn", _yarn(lines, starts)).when(form == "pnpm", _pnpm(lines, starts)).when(form == "go_mod", _go_mod(lines, starts))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), form)
    # outer: else the plan tests the size of the array first, which computes it twice
    d = d.select("repo", "path", "form", kind.alias("kind"), F.explode_outer(items).alias("i"))
    d = d.select("repo", F.col("i.name").alias("name"), "kind", F.col("i.version").alias("version"), F.col("path").alias("file_path"), F.col("i.is_dev").alias("is_dev"), "form")
    return d.where((F.col("name") != "") & ((F.col("version") != "") | ~form.isin(*VERSIONED))).drop("form")
