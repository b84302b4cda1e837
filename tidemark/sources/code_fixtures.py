"""Source files and manifests derived from ``lineitem``: one file an order, its lines from the order's rows.

They stand in for repositories; the SQL beside each query says what must be found in them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.fixtures import table

GO_MODULE = "example.com/mod"

#: What the SQL of all queries begins with: o order, n line, nm name, x the order that the line imports.
ROWS_SQL = """
fx_rows AS (SELECT l_orderkey AS o, l_linenumber AS n, 'f'||l_partkey||'_'||l_linenumber AS nm, l_orderkey % 9 AS lang, 'r'||(l_orderkey % 4) AS repo,
  36 * (l_partkey % 400) + CASE l_orderkey % 9 WHEN 2 THEN (l_orderkey + 8) % 36 ELSE l_orderkey % 36 END AS x,
  l_linenumber||'.'||(l_partkey % 10)||'.0' AS v, l_linenumber % 2 = 0 AS dev, l_orderkey % 13 AS form FROM lineitem)
"""
PATH_SQL = """CASE {o} % 9 WHEN 0 THEN 'pkg/m'||{o}||'.py' WHEN 1 THEN 'web/m'||{o}||'.js' WHEN 2 THEN 'app/m'||{o}||'.ts' WHEN 3 THEN 'rb/m'||{o}||'.rb'
  WHEN 4 THEN 'go/m'||{o}||'/main.go' WHEN 5 THEN 'src/m'||{o}||'.rs' WHEN 6 THEN 'java/com/acme/p'||({o} % 5)||'/M'||{o}||'.java'
  WHEN 7 THEN 'cc/m'||{o}||'.hpp' ELSE 'include/inc/m'||{o}||'.h' END"""


def _repo(order: Column) -> Column:
    return F.concat(F.lit("r"), (order % 4).cast("string"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, o, l: the orders, their lines as numbers, so no text is shuffled.

    ``o`` is the minimum of the key, not the key: a filter on what is made from it then runs once an order, not once a line.
    """
    o = F.col("l_orderkey")
    r = table(spark, sf_dir, "lineitem").groupBy(o).agg(F.min(o).alias("o"), F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))).alias("l"))
    return r.select(_repo(F.col("o")).alias("repo"), "o", "l")


def _by(number: Column, cases: list[Column]) -> Column:
    out = F.when(number == 0, cases[0])
    for k, c in enumerate(cases[1:], 1):
        out = out.when(number == k, c)
    return out


def _fill(template: str, x: Column) -> Column:
    """A template with %N (name), %X (imported order), %V (version) and %P (imported order % 5) for a line ``x`` of order ``o``."""
    o, p, n = F.col("o"), x["p"], x["n"]
    s = lambda c: c.cast("string")
    to = 36 * (p % 400) + F.when(o % 9 == 2, (o + 8) % 36).otherwise(o % 36)
    marks = {
        "%N": [F.lit("f"), s(p), F.lit("_"), s(n)], "%X": [s(to)], "%P": [s(to % 5)],
        "%V": [s(n), F.lit("."), s(p % 10), F.lit(".0")],
    }
    parts = [c for piece in re.split("(%[NXPV])", template) if piece for c in marks.get(piece, [F.lit(piece)])]
    return F.concat(*parts)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content: sources in nine languages; each line declares one thing and imports another file."""
    declares = [
        "async def %N(a, b):  # it's", "export const %N = async (a) => a; // import 'no'", "export interface %N {", "  def self.%N(a) # it's",
        "func (s *T) %N(a int) error { // x", "pub(crate) fn %N(a: u8) -> u8 {", "  public static int %N(int a) {", "static int %N(int a) {", "struct %N {",
    ]
    includes = [
        "from pkg.m%X import %N as q\nfrom .m%X import y", "import { %N } from './m%X'", 'import * as q from "../web/m%X";', "require_relative './m%X'",
        f'\t"{GO_MODULE}/go/m%X"', "use crate::m%X::{A, b::{self, C}};", "import com.acme.p%P.M%X;", '#include "m%X.hpp"', '#include "inc/m%X.h"',
    ]
    lang = F.col("o") % 9
    texts = lambda i, d: F.transform("l", lambda x: F.struct(x["n"].alias("n"), _fill(i, x).alias("imp"), _fill(d, x).alias("dec")))
    g = _orders(spark, sf_dir).withColumn("l", F.array_sort(_by(lang, [texts(*t) for t in zip(includes, declares, strict=True)])))
    block = lambda f: F.array_join(F.transform("l", lambda x: x[f]), "\n")
    go = F.concat(F.lit("package p\n\nimport (\n"), block("imp"), F.lit("\n)\n\n/* func No(\n) */\nvar s = `\nfunc No()\n`\n"), block("dec"), F.lit("\n"))
    content = F.when(F.col("o") % 9 == 4, go).otherwise(F.concat(block("imp"), F.lit("\n"), block("dec"), F.lit("\n")))
    return g.select("repo", F.expr(PATH_SQL.format(o="o")).alias("path"), content.alias("content"))


def go_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(_repo(o).alias("repo")).distinct().withColumn("module", F.lit(GO_MODULE))


#: Path, entry of the main block, entry of the development block and the text around both, by format.
MANIFESTS = [
    ("package.json", '"@s/%N": "^%V "', '"@s/%N": "^%V "', '{"name": "x", "dependencies": {<A>}, "devDependencies": {<B>}, "files": [1]}', ", "),
    ("package-lock.json", '"node_modules/a/node_modules/@s/%N": {"version": "%V"}', '"node_modules/@s/%N": {"version": "%V", "dev": true}', '{"packages": {"": {"version": "1"}, <AB>}}', ", "),
    ("yarn.lock", '"%N@^1", %N@^2:\n  version "%V"\n  resolved "u"', '# c\n%N@^1:\n  version "%V"', "# yarn\n\n<AB>\n", "\n\n"),
    ("pnpm-lock.yaml", "  /@s/%N@%V(react@18.0.0):\n    dev: false", "  /@s/%N/%V:\n    dev: true", "lockfileVersion: 6\nimporters:\n  /no@1:\n\npackages:\n\n<AB>\n", "\n"),
    ("requirements.txt", "%N[extra]>=%V ; python_version > '3'", "%N==%V # pinned", "-r base.txt\n\n# all\n<AB>\n", "\n"),
    ("pyproject.toml", '"%N[x]>=%V; python_version > \'3\'"', '"%N == %V"', '[project]\ndependencies = [<A>]\n[project.optional-dependencies]\ndev = [<B>]\n[tool.poetry.dependencies]\npython = "^3"\n', ", "),
    ("uv.lock", '[[package]]\nname = "%N"\nversion = "%V"', '[[package]]\nname = "%N"\nversion = "%V"', "version = 1\n<AB>\n", "\n"),
    ("poetry.lock", '[[package]]\nname = "%N"\nversion = "%V"', '[[package]]\nname = "%N"', "<AB>\n", "\n"),
    ("Pipfile.lock", '"%N": {"version": "==%V"}', '"%N": {"version": "==%V"}', '{"default": {<A>}, "develop": {<B>}}', ", "),
    ("composer.json", '"v/%N": "^%V"', '"v/%N": "^%V"', '{"require": {"php": "^8", <A>}, "require-dev": {<B>}}', ", "),
    ("composer.lock", '{"name": "v/%N", "version": "%V"}', '{"name": "v/%N", "version": "%V"}', '{"packages": [<A>], "packages-dev": [<B>]}', ", "),
    ("go.mod", "\tx.y/%N v%V", "\tx.y/%N v%V // indirect", "module m\n\ngo 1.22\n\nrequire (\n<AB>\n)\n", "\n"),
    ("Dockerfile", "FROM reg:5000/%N:%V AS b", "from %N", "# syntax\n<AB>\nRUN x\n", "\n"),
]


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content: one manifest an order, its format by the order's number, odd lines in the main block."""
    form = F.col("o") % len(MANIFESTS)
    def entries(main: str, dev: str) -> Column:
        even = lambda x: x["n"] % 2 == 0
        return F.transform("l", lambda x: F.struct(x["n"].alias("n"), F.when(even(x), _fill(dev, x)).otherwise(_fill(main, x)).alias("entry"), even(x).alias("dev")))

    g = _orders(spark, sf_dir).withColumn("l", F.array_sort(_by(form, [entries(m[1], m[2]) for m in MANIFESTS])))
    kept = {"<AB>": lambda x: F.lit(True), "<A>": lambda x: ~x["dev"], "<B>": lambda x: x["dev"]}

    def text(template: str, joint: str) -> Column:
        block = lambda mark: F.array_join(F.transform(F.filter("l", kept[mark]), lambda x: x["entry"]), joint)
        return F.concat(*[block(piece) if piece in kept else F.lit(piece) for piece in re.split("(<AB?>|<B>)", template) if piece])

    texts = [text(m[3], m[4]) for m in MANIFESTS]
    some = F.exists("l", lambda x: ~x["dev"])
    texts[9] = F.when(some, texts[9]).otherwise(text(MANIFESTS[9][3].replace(", <A>", ""), MANIFESTS[9][4]))
    content = _by(form, texts)
    base = _by(form, [F.lit(m[0]) for m in MANIFESTS])
    path = F.concat(F.lit("d"), F.col("o").cast("string"), F.when((form == 4) & (F.col("o") % 2 == 0), "/requirements-dev.txt").otherwise(F.concat(F.lit("/"), base)))
    return g.select("repo", path.alias("path"), content.alias("content"))
