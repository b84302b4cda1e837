"""Graph and package operators over several repositories with the same paths."""

import random

import pytest

from tidemark.operators import graph, index

REFS = "repo string, source_path string, source_symbol string, target_path string, target_symbol string"


def plain_radius(seeds, symbols, refs, hops):
    out = {}
    for seed_id in {s[0] for s in seeds}:
        files = {(r, p) for s, r, p in seeds if s == seed_id}
        seen, front, depth = set(files), {(r, p, n) for r, p, n in symbols if (r, p) in files}, 0
        while front and (hops is None or depth < hops):
            depth += 1
            hit = {(r, sp, ss) for r, sp, ss, tp, ts in refs if (r, tp, ts) in front and (r, sp) not in seen}
            for r, p, s in hit:
                out.setdefault((seed_id, r, p, depth), set()).add(s)
            seen |= {(r, p) for r, p, _ in hit}
            front = hit
    return {(*k, tuple(sorted(v))) for k, v in out.items()}


@pytest.mark.parametrize("hops,hub", [(2, 100), (4, 3), (None, 2)])
def test_blast_radius_equals_a_plain_search(spark, hops, hub):
    rng = random.Random(7)
    paths = [f"f{i}.py" for i in range(40)]
    refs = {(rng.choice("ab"), rng.choice(paths), rng.choice("xyz"), rng.choice(paths), rng.choice("xyz")) for _ in range(130)}
    refs |= {("a", p, "x", "f0.py", "hub") for p in paths[1:30]}
    symbols = {(r, p, s) for r in "ab" for p in paths for s in ("x", "y", "hub")}
    seeds = [(k, r, p) for k, r, p in ((1, "a", "f0.py"), (1, "a", "f1.py"), (2, "b", "f0.py"), (3, "a", "f7.py"), (3, "b", "f9.py"), (4, "c", "f0.py"))]
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = graph.blast_radius(frame(seeds, "seed_id int, repo string, path string"), frame(symbols, "repo string, file_path string, name string"), frame(refs, REFS), hops, hub)
    assert {(r.seed_id, r.repo, r.path, r.depth, tuple(r.symbols)) for r in got.collect()} == plain_radius(seeds, symbols, refs, hops)


def test_repositories_with_equal_paths_keep_apart(spark):
    refs = spark.createDataFrame([("a", "m.py", "f", "t.py", "g"), ("b", "n.py", "f", "t.py", "g"), ("b", "n.py", "h", "t.py", "g")], REFS)
    imports = spark.createDataFrame([("a", "m.py", "t.py"), ("b", "t.py", "m.py")], "repo string, source_path string, target_path string")
    paths = spark.createDataFrame([("a", "t.py"), ("b", "t.py"), ("b", "x.py")], "repo string, path string")
    got = graph.inbound_edges(paths, imports, refs)
    assert {tuple(r) for r in got.collect()} == {("a", "t.py", 2), ("b", "t.py", 1), ("b", "x.py", 0)}
    changed = spark.createDataFrame([("a", "t.py", 1), ("b", "t.py", 2), ("b", "x.py", 1)], "repo string, path string, ord int")
    assert {(r.repo, r.path, r.rank) for r in graph.rank_by_inbound(changed, got).collect()} == {("a", "t.py", 1), ("b", "t.py", 1), ("b", "x.py", 2)}
    assert [tuple(r) for r in graph.one_hop(changed, imports).collect()] == [("b", "m.py")]
    assert [(r.repo, r.source_path) for r in graph.importers(changed, imports).collect()] == [("a", "m.py")]


def test_packages_of_another_repository_stay(spark):
    schema = "repo string, file_path string, name string, kind string, version string, ord int"
    old = spark.createDataFrame([("a", "package.json", "x", "npm", "1", 0), ("b", "package.json", "y", "npm", "1", 0), ("b", "gone.json", "z", "npm", "1", 0)], schema)
    new = spark.createDataFrame([("a", "package.json", "x", "npm", "2", 1), ("a", "package.json", "x", "npm", "3", 2)], schema)
    live = spark.createDataFrame([("a", "package.json"), ("b", "package.json"), ("a", "gone.json")], "repo string, file_path string")
    assert {(r.repo, r.name, r.version) for r in index.replace_packages(old, new, live).collect()} == {("a", "x", "3"), ("b", "y", "1")}
