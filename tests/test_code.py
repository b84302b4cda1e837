"""Symbols, imports, manifests and import resolution on cases."""

import io
import re
import tarfile

from tidemark.operators import graph, imports, selection
from tidemark.sources import code, manifests, snapshot

FILES = {
    "a.py": 'import os, sys as s  # import no\nfrom .x import (b as c, *)\nclass A(B):\n    async def f(self, x): pass\ndef g(): return "# not"\n',
    "a.js": "import x from './x'\nimport './side'\nconst fs = require(\"fs\"); // require('no')\nconst t = \"require('fake')\";\nexport default class K {}\nconst f = async (a, b) => 1\nlet m = import('./dyn')\n",
    "a.ts": "export type T = string\nexport const enum E {}\nexport default interface I {}\nexport function g<T>(a: T) {}\n",
    "a.rb": "module M\n  class C\n    def self.run(x) # y\n  require_relative '../z'\n",
    "a.java": "import static a.b.C.d;\nimport a.*;\npublic record R(int x) {}\nfinal class K { // class No\n  public List<String> get(int a) {\n  if (x) {\n",
    "a.cpp": '#include "own/a.hpp"\n#include <vector>\ntemplate <typename T> class V {\ninline std::vector<int> f(int a) {\nreturn g(1);\n',
    "a.rs": "use std::io;\nuse crate::a::{self, b::{C, d as e}, f::*};\npub(crate) async fn go<T>(x: u8) {}\nimpl<T> Show for Thing {}\nunsafe trait Q {}\n",
    "a.go": 'package p\n\nimport (\n\tx "a/b"\n\t// "no"\n\t_ "c/d"\n)\nimport "e"\nconst (\n\tA = 1\n\tB\n)\ntype T struct {\n}\ntype U = int\n/* func no() {\n*/\nvar s = `\nfunc no2() {\n`\nfunc (t *T) Do(x int) error {\n',
    "note.md": "class No\n",
}


def table(spark, files, repo="r"):
    return spark.createDataFrame([(repo, p, c) for p, c in files.items()], "repo string, path string, content string")


def test_symbols_and_imports(spark):
    lines = code.code_lines(table(spark, FILES)).cache()
    got = {}
    for r in code.symbols(lines).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.name, r.kind, r.signature))
    assert got == {
        "a.py": [("A", "class", "A"), ("f", "method", "f(self, x)"), ("g", "function", "g()")],
        "a.js": [("fs", "constant", "fs"), ("t", "constant", "t"), ("K", "class", "K"), ("f", "function", "f"), ("m", "variable", "m")],
        "a.ts": [("T", "type", "T"), ("E", "enum", "E"), ("I", "interface", "I"), ("g", "function", "g")],
        "a.rb": [("M", "module", "M"), ("C", "class", "C"), ("run", "function", "run(x)")],
        "a.java": [("R", "class", "R"), ("K", "class", "K"), ("get", "method", "get")],
        "a.cpp": [("V", "class", "V"), ("f", "function", "f")],
        "a.rs": [("go", "function", "go(x: u8)"), ("Thing", "type", "Thing"), ("Q", "trait", "Q")],
        "a.go": [("A", "constant", "A"), ("B", "constant", "B"), ("T", "struct", "T"), ("U", "type", "U"), ("s", "variable", "s"), ("Do", "method", "(t *T) Do(x int)")],
    }
    found = {}
    for r in code.imports(lines).orderBy("path", "ord", "nth").collect():
        found.setdefault(r.path, []).append(r["import"])
    assert found == {
        "a.py": ["os", "sys", ".x.b", ".x"], "a.js": ["./x", "./side", "fs", "./dyn"], "a.rb": ["../z"], "a.java": ["a.b.C.d"], "a.cpp": ["own/a.hpp"],
        "a.rs": ["std::io", "crate::a", "crate::a::b::C", "crate::a::b::d", "crate::a::f"], "a.go": ["a/b", "c/d", "e"],
    }


def test_manifests(spark):
    files = {
        "package.json": '{"dependencies": {"a": " ^1 ", "b": 2, "c": {"x": 1}}, "devDependencies": {"d": "*"}}', "bad/package.json": '{"dependencies": {"a": "1"}',
        "package-lock.json": '{"packages": {"": {"version": "9"}, "node_modules/@s/x/y": {"version": "1", "dev": true}, "node_modules/z": {}}}', "old/package-lock.json": '{"dependencies": {"q": {"version": "2"}}}',
        "yarn.lock": '"@s/a@^1", b@2:\n  version "1.0"\n  dependencies:\n    x "1"\n\nc@1:\n  resolved "u"\nd:\n  version\t"3"\n',
        "pnpm-lock.yaml": "packages:\n  /a@1(b@2):\n  '/c/2':\n  /@s/n/3:\n  /@s/m@4:\nother:\n  /no@1:\n",
        "x/requirements-dev.txt": "-r a\n\nflask\nq[x]==1 # c\n./local\nw>=1,<2;x\n", "pyproject.toml": '[tool.poetry.group.docs.dependencies]\nd = {version = "^2"}\n[tool.poetry.dependencies]\npython = "3"\np = ["x"]\n',
        "bad/pyproject.toml": "[x", "uv.lock": '[[package]]\nname = "u"\nversion = "1"\n[[package]]\nname = "v"\n', "go.mod": "module m\nrequire a/b v1.0.0 // indirect\nrequire (\n\tc/d v2.0.0\n)\nreplace (\n\te/f v1.0.0 => ./x\n)\n",
        "Dockerfile": "from a:1 AS b\nFROM $X\nFROM h:5/i\nFROM j\nRUN FROM k\n", "composer.json": '{"require": {"php": "8", "v/a": " 1 "}}', "README.md": "FROM x",
    }
    got = sorted((r.file_path, r.name, r.kind, r.version, r.is_dev) for r in manifests.packages(table(spark, files)).collect())
    assert got == sorted([
        ("package.json", "a", "npm", "^1", False), ("package.json", "d", "npm", "*", True), ("package-lock.json", "@s/x", "npm", "1", True), ("old/package-lock.json", "q", "npm", "2", False),
        ("yarn.lock", "@s/a", "npm", "1.0", False), ("yarn.lock", "d", "npm", "3", False), ("pnpm-lock.yaml", "a", "npm", "1", False),
        ("pnpm-lock.yaml", "@s/n", "npm", "3", False), ("pnpm-lock.yaml", "@s/m", "npm", "4", False), ("x/requirements-dev.txt", "flask", "pip", "", True),
        ("x/requirements-dev.txt", "q", "pip", "==1", True), ("x/requirements-dev.txt", "w", "pip", ">=1,<2", True), ("pyproject.toml", "d", "pip", "^2", True), ("pyproject.toml", "p", "pip", "", False),
        ("uv.lock", "u", "pip", "1", False), ("go.mod", "a/b", "go", "v1.0.0", True), ("go.mod", "c/d", "go", "v2.0.0", False), ("Dockerfile", "a", "docker", "1", False), ("Dockerfile", "$X", "docker", "", False),
        ("Dockerfile", "h", "docker", "5/i", False), ("Dockerfile", "j", "docker", "", False), ("composer.json", "v/a", "composer", "1", False),
    ])


def test_import_targets_by_language(spark):
    files = {
        "pkg/a.py": "from util import x\nimport lib2.m\nfrom . import y\n", "web/a.ts": "import a from './b'\nimport c from '../lib'\nimport r from 'react'\n", "src/net/a.rs": "use crate::http::Client;\nuse super::dns;\nuse std::io;\n",
        "J.java": "import com.acme.util.Text;\nimport static com.acme.Other.name;\nimport java.util.*;\n", "cmd/a.go": 'import (\n\t"fmt"\n\t"net/http"\n\t"m.io/x/store"\n\t"zz.com/q/deep/er"\n)\nvar s = "m.io/x/store/no"\n',
        "a/b.cc": '#include "c.hpp"\n',
    }
    tree = [*files, "pkg/util.py", "util.py", "src/lib2/m.py", "web/b.tsx", "lib/index.js", "src/http.rs", "src/net/dns.rs", "x/com/acme/util/Text.java", "y/util/Text.java", "Other.java", "store/store.go", "store/a.go", "store/a_test.go", "store/z.go", "vendor/q/deep/er/f.go", "a/c.hpp", "include/c.hpp"]
    d = table(spark, files)
    paths = spark.createDataFrame([("r", p) for p in tree], "repo string, path string")
    resolve = lambda modules: imports.resolved_imports(d, paths, spark.createDataFrame(modules, "repo string, module string"))
    got = {}
    for r in resolve([("r", "m.io/x")]).orderBy("path", "import", "choice").collect():
        got.setdefault((r.path, r["import"]), []).append(r.target)
    assert got == {
        ("pkg/a.py", "util"): ["util.py", "pkg/util.py"], ("pkg/a.py", "lib2.m"): ["src/lib2/m.py"], ("web/a.ts", "./b"): ["web/b.tsx"], ("web/a.ts", "../lib"): ["lib/index.js"],
        ("src/net/a.rs", "crate::http::Client"): ["src/http.rs"], ("src/net/a.rs", "super::dns"): ["src/net/dns.rs"], ("J.java", "com.acme.util.Text"): ["x/com/acme/util/Text.java"],
        ("J.java", "com.acme.Other.name"): ["Other.java"], ("cmd/a.go", "m.io/x/store"): ["store/store.go", "store/a.go"], ("a/b.cc", "c.hpp"): ["a/c.hpp", "include/c.hpp"],
    }
    loose = {(r.path, r["import"]): r.target for r in resolve([("other", "m")]).where("path = 'cmd/a.go'").collect()}
    assert loose == {("cmd/a.go", "zz.com/q/deep/er"): "vendor/q/deep/er/f.go"}


def test_package_edges_and_importers(spark):
    files = {
        "cmd/api/m.go": 'import (\n\t"m.io/store"\n\t"fmt"\n)\nfunc f() { store.Get() }\nvar x = store.Y\n', "web/ui/a.ts": "import x from '../lib/b.js'\nexport * from './same/c'\nconst d = await import('@app/d')\n",
        "py/app/a.py": "from ..core import x\nfrom . import y\nimport py.z.w\nimport os\n", "root.go": 'import "m.io/store"\n', "store/s.go": 'import "m.io/store/sub"\n', "store/s_test.go": 'import "m.io/store"\n',
    }
    d = table(spark, files)
    edges = lambda m: sorted((r.src, r.dst) for r in imports.package_edges(d, spark.createDataFrame([("r", m)], "repo string, module string")).collect())
    relative = [("py/app", "py/core"), ("web/ui", "web/lib/b"), ("web/ui", "web/ui/same/c")]
    assert edges("m.io") == sorted([("cmd/api", "store"), ("store", "store/sub"), *relative])
    assert edges("py") == sorted([("py/app", "py/z/w"), *relative]) and edges("@app/") == sorted([("web/ui", "d"), *relative])
    changed = spark.createDataFrame([(1, "r", "store/s.go"), (1, "r", "root.go"), (2, "r", "store/s_test.go")], "change_id int, repo string, path string")
    got = graph.package_importers(changed, d, spark.createDataFrame([("r", "m.io")], "repo string, module string")).collect()
    assert [(r.change_id, r.path, r.package, r.lines) for r in got] == [(1, "cmd/api/m.go", "store", ["5: func f() { store.Get() }", "6: var x = store.Y"])]


def test_archives_keep_hidden_names(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, body in (("./pkg/__init__.py", b""), (".git/x", b"1"), (".env", b"\xff\xfea"), ("big", b"x" * 100), ("a/__pycache__/b", b"2")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    d = spark.createDataFrame([("r", bytearray(out.getvalue())), ("damaged", bytearray(b"no archive"))], "repo string, content binary")
    got = {r.path: r.content for r in snapshot.archived_files(d, max_bytes=50).collect()}
    assert got == {"pkg/__init__.py": "", ".env": "��a"}


def test_ignore_rules_by_repository(spark):
    files = spark.createDataFrame([("a", "x.log"), ("a", "keep.log"), ("b", "x.log"), ("c", "x.log"), ("a", "vendor/y"), ("b", "out/z")], "repo string, path string")
    rules = spark.createDataFrame([("a", 1, "*.log"), ("a", 2, "!keep.log"), ("b", 1, "# no"), ("b", 2, "/out/")], "repo string, ord int, line string")
    got = {(r.repo, r.path): r.ignored for r in selection.gitignored_by_repo(files, rules).collect()}
    assert got == {("a", "x.log"): True, ("a", "keep.log"): False, ("b", "x.log"): False, ("c", "x.log"): False, ("a", "vendor/y"): True, ("b", "out/z"): True}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_targets_are_guessed_once_a_folder(spark):
    """Each file's import had guesses of its own, up to ten rows that were shuffled."""
    d = table(spark, {**{f"pkg/f{k}.py": "import util\n" for k in range(5)}, "src/a/x.rs": "use crate::m::T;\n"})
    tree = spark.createDataFrame([("r", p) for p in ("pkg/util.py", "src/m.rs")], "repo string, path string")
    got = imports.resolved_imports(d, tree, spark.createDataFrame([("r", "m.io")], "repo string, module string"))
    assert sorted((r.path, r.target, r.choice) for r in got.collect()) == [*[(f"pkg/f{k}.py", "pkg/util.py", 1) for k in range(5)], ("src/a/x.rs", "src/m.rs", 1)]
    assert re.search(r"hashpartitioning\(repo#\d+, lang#\d+, folder#\d+, import#\d+", plan_of(got)), plan_of(got)


def test_package_edges_read_the_texts_once(spark):
    """Go files were read twice, the others once for each language, and texts were shuffled to meet their module."""
    d = table(spark, {"a/x.go": 'import "m.io/b"\n', "w/a.ts": "import '../v'\n", "p/q/a.py": "from ..r import z\n"})
    got = imports.package_edges(d, spark.createDataFrame([("r", "m.io")], "repo string, module string"))
    assert sorted(map(tuple, got.collect())) == [("r", "a", "b"), ("r", "p/q", "p/r"), ("r", "w", "v")]
    plan = plan_of(got).split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bGenerate\b", plan)) == 1 and plan.count("SortMergeJoin") == 1, plan


def test_package_nodes_read_the_texts_once(spark):
    d = table(spark, {"a/x.go": 'import "m.io/b"\nimport "m.io/c"\n', "w/a.ts": "import '../v'\n"})
    got = imports.package_nodes(imports.package_edges(d, spark.createDataFrame([("r", "m.io")], "repo string, module string")), most=3)
    assert sorted((r.package, r["rank"], r.n_packages) for r in got.collect()) == [("a", 1, 5), ("b", 2, 5), ("c", 3, 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2 * 5, plan  # once on either side, which share the exchange


def test_lines_without_a_comment_are_not_matched_for_one(spark):
    d = table(spark, {"a.js": "const a = 1 // no\nconst b = 'x//y'\nclass C {\r\n", "a.py": "def f(a):\n  x = '#' # c\nclass D: #\n"})
    lines = code.code_lines(d)
    assert sorted((r.path, r.line) for r in lines.where("line <> ''").collect()) == sorted(
        [("a.js", "const a = 1 "), ("a.js", "const b = 'x//y'"), ("a.js", "class C {\r"), ("a.py", "def f(a):"), ("a.py", "  x = '#' "), ("a.py", "class D: ")]
    )
    assert re.search(r"Contains\(l#\d+\.raw", plan_of(lines)), plan_of(lines)


def test_first_places_of_imports_need_no_sort(spark):
    """A struct as the minimum made Spark sort the imports, twice; all lines were matched for declarations."""
    d = table(spark, {"a.py": "import b\nimport a, b\nx = 1\nimport a\n", "a.rs": "use //c\n use a::{b, c};\n"})
    got = code.imports(code.code_lines(d))
    assert sorted((r.path, r.ord, r.nth, r["import"]) for r in got.collect()) == [("a.py", 0, 0, "b"), ("a.py", 1, 0, "a"), ("a.rs", 1, 0, "a::b"), ("a.rs", 1, 1, "a::c")]
    assert "SortAggregate" not in plan_of(got), plan_of(got)


def test_manifests_become_packages_in_one_pass(spark):
    """The manifests were written by format and read eleven times; yarn, pnpm and go.mod were shuffled by line; JSON was parsed for the plan's own test of each array's size."""
    files = {
        "yarn.lock": 'a@1:\r\n  x "1"\n  version "2"\r\n  version "3"\nb@1:\nversion "9"\n', "pnpm-lock.yaml": "no:\n  /n@1:\npackages: # x\n  /a@1:\nend:\n  /n@1:\npackages:\n  /b/2:\n",
        "go.mod": "require a v1\nb v1\nrequire (\n c v2\n) // end\nd v3\nrequire e v4\n", "Pipfile.lock": '{"default": {"a": {"version": "1"}}, "develop": [1]}', "package.json": '{"dependencies": {"a": NaN, "b": "1"}}',
    }
    got = manifests.packages(table(spark, files))
    assert sorted((r.file_path, r.name, r.version) for r in got.collect()) == sorted(
        [("yarn.lock", "a", "2"), ("yarn.lock", "b", "9"), ("pnpm-lock.yaml", "a", "1"), ("pnpm-lock.yaml", "b", "2"), ("go.mod", "a", "v1"), ("go.mod", "c", "v2"), ("go.mod", "e", "v4"), ("Pipfile.lock", "a", "1")]
    )
    plan = plan_of(got)
    assert "Exchange" not in plan and "Union" not in plan and plan.count("from_json") == 5 and len(re.findall(r"\bGenerate\b", plan)) == 1, plan


def test_toml_manifests_with_other_types_are_left_out(spark):
    """A version that is a number ended the job."""
    files = {"uv.lock": '[[package]]\nname = "a"\nversion = 1\n', "pyproject.toml": "[project]\ndependencies = [1]\n", "poetry.lock": '[[package]]\nname = "b"\nversion = "2"\n'}
    assert [(r.name, r.version) for r in manifests.packages(table(spark, files)).collect()] == [("b", "2")]


def test_package_edges_deal_a_repository_into_parts(spark):
    """A repository's imports met their module in one task, and stayed there for its edges, packages and ranks."""
    d = table(spark, {**{f"a{k}/x.go": f'import "m.io/b{k}"\n' for k in range(40)}, "a/x.py": "from ..r import z\n", "a/x.rs": "use z;\n"})
    got = imports.package_edges(d, spark.createDataFrame([("r", "m.io"), ("q", "m")], "repo string, module string"))
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted([*[(f"a{k}", f"b{k}") for k in range(40)], ("a", "r")])
    plan = plan_of(got)
    assert re.search(r"hashpartitioning\(repo#\d+, part#\d+", plan) and re.search(r"hashpartitioning\(repo#\d+, src#\d+, dst#\d+", plan), plan
