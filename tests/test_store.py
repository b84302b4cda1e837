"""The finding store and session documents."""

import json

import pytest

from tidemark.sources import store, versions

SCHEMA = "owner string, repo string, pr long, path string, start_line int"


def test_store(spark, tmp_path):
    at = str(tmp_path / "findings")
    one = spark.createDataFrame([("1", "r", 1, "a", 3), ("1", "r", 2, "b", 4)], SCHEMA)
    assert store.read_findings(spark, at, one.schema).count() == 0
    store.write_findings(one, one, at)
    rows = lambda: sorted(tuple(r) for r in store.read_findings(spark, at, one.schema).collect())
    assert rows() == [("1", "r", 1, "a", 3), ("1", "r", 2, "b", 4)]
    store.write_findings(one.where("false"), one.where("pr = 1"), at)
    assert rows() == [("1", "r", 2, "b", 4)]


def test_envelopes(spark):
    s = spark.createDataFrame(
        [("a", ["x"], ("walk", ""), (["d"],)), ("b", [], ("", None), ([],)), ("c", None, None, None)],
        "session_id string, overlap array<string>, summary struct<walkthrough: string, risk: string>, labels struct<domains: array<string>>",
    )
    c = spark.createDataFrame([("a", 2, "p", "", 0.0), ("a", 1, "q", "HIGH", 0.5)], "session_id string, ord int, path string, severity string, confidence double")
    got = {r.session_id: json.loads(r.document) for r in store.envelopes(s, c).collect()}
    assert got["a"] == {
        "session_id": "a", "comments": [{"path": "q", "severity": "HIGH", "confidence": 0.5}, {"path": "p"}], "overlap": ["x"],
        "summary": {"walkthrough": "walk", "risk": ""}, "labels": {"domains": ["d"]},
    }
    assert got["b"] == {"session_id": "b", "comments": []} and got["c"] == {"session_id": "c", "comments": []}


def test_a_write_without_its_commit_leaves_the_old_state(spark, tmp_path):
    at = str(tmp_path / "findings")
    one = spark.createDataFrame([("1", "r", 1, "a", 3), ("1", "r", 2, "b", 4)], SCHEMA)
    kept = versions.Store(spark, at, ("owner", "repo", "pr"), {"findings": SCHEMA}, compact_every=3)
    rows = lambda: sorted(tuple(r) for r in kept.read("findings").collect())
    kept.replace({"findings": one}, one, tag=1)
    kept.replace({}, one, tag=1)  # has happened already
    before = rows()
    fail = lambda state: (_ for _ in ()).throw(RuntimeError("lost"))
    whole, kept._commit = kept._commit, fail
    with pytest.raises(RuntimeError):
        kept.replace({}, one)
    kept._commit = whole
    assert rows() == before == sorted(tuple(r) for r in one.collect()) and kept.state()["version"] == 0
    stale = kept.state()
    for k in range(1, 8):
        kept.replace({"findings": one.where("pr = 2").selectExpr("owner", "repo", "pr", "path", f"{k} start_line")}, one.where("pr = 2"))
    assert rows() == [("1", "r", 1, "a", 3), ("1", "r", 2, "b", 7)]
    assert len(kept.state()["parts"]) == 3 and len([f for f in (tmp_path / "findings").iterdir() if f.name.startswith("version")]) <= 6
    with pytest.raises(Exception, match="already exist"):  # a second writer that began from an old state
        kept._commit(stale | {"version": 7})
    assert kept.read("findings", kept.touched(one.where("pr = 1"))).where("pr = 1").count() == 1


def test_tables_of_a_store_change_together(spark, tmp_path):
    tables = {"files": "repo string, path string, hash string", "symbols": "repo string, path string, name string"}
    s = versions.Store(spark, str(tmp_path), ("repo", "path"), tables)
    files = spark.createDataFrame([("a", "x.py", "1"), ("b", "x.py", "2")], tables["files"])
    names = spark.createDataFrame([("a", "x.py", "f"), ("a", "x.py", "g"), ("b", "x.py", "f")], tables["symbols"])
    s.replace({"files": files, "symbols": names}, files)
    s.replace({"files": files.where("repo = 'a'").selectExpr("repo", "path", "'3' hash"), "symbols": names.where("name = 'g'")}, files.where("repo = 'a'"))
    assert sorted(map(tuple, s.read("files").collect())) == [("a", "x.py", "3"), ("b", "x.py", "2")]
    assert sorted(map(tuple, s.read("symbols").collect())) == [("a", "x.py", "g"), ("b", "x.py", "f")]
    s.replace({}, files.where("repo = 'b'"))  # the file is gone, and with it its symbols
    assert [tuple(r) for r in s.read("symbols").collect()] == [("a", "x.py", "g")] and s.read("files").count() == 1
