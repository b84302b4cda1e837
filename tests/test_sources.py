"""Diffs, reports, SARIF and the streaming job on small cases."""

import json
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import sarif
from tidemark.sources import diffs, reports
from tidemark.streaming.continuous import current_state, reconcile_stream

DIFF = """diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -3,3 +3,4 @@ def f
 keep
-old
+new
+++i
 end
\\ No newline at end of file
diff --git a/o.txt b/n.txt
similarity index 90%
rename from o.txt
rename to n.txt
diff --git a/d.bin b/d.bin
deleted file mode 100644
Binary files a/d.bin and /dev/null differ"""


def test_diffs(spark):
    d = spark.createDataFrame([(1, DIFF), (2, "no diff")], "diff_id long, text string")
    f = {r.file_no: r for r in diffs.file_changes(d).collect()}
    assert len(f) == 3 and (f[1].old_path, f[1].new_path, f[1].insertions, f[1].deletions) == ("a.py", "a.py", 2, 1)
    assert "index 1..2" not in f[1].diff and f[2].is_renamed and (f[2].old_path, f[2].new_path) == ("o.txt", "n.txt")
    assert f[3].is_deleted and f[3].is_binary and f[3].new_path == "/dev/null"
    got = [(r.type, r.content, r.old_line, r.new_line) for r in diffs.hunk_lines(d).orderBy("pos").collect()]
    assert got == [("context", "keep", 3, 3), ("deleted", "old", 4, None), ("added", "new", None, 4), ("added", "++i", None, 5), ("context", "end", 5, 6)]


def test_reports(spark):
    leak = json.dumps([{"RuleID": "aws", "File": "/r/a.go", "StartLine": 3, "Match": "k=xyz", "Secret": "xyz"}])
    r = reports.gitleaks_findings(spark.createDataFrame([(1, "/r", leak)], "report_id long, root string, body string")).first()
    assert (r.path, r.line, r.evidence, r.description) == ("a.go", 3, "k=***REDACTED***", 'gitleaks rule "aws" matched')
    body = json.dumps({"results": [{"check_id": "x", "path": "p", "start": {"line": 2}, "extra": {"message": "", "severity": "error", "lines": " l "}}]})
    r = reports.semgrep_findings(spark.createDataFrame([(1, body)], "report_id long, body string")).first()
    assert (r.severity, r.description, r.evidence) == ("HIGH", "x", "l")


def test_sarif(spark):
    rows = [("r1", 1, "llm", "b", "p", 0, 0, "HIGH", "d", "f"), ("r1", 2, "llm", "a", "p", 3, 5, "SUPPRESS", "d", ""), ("r1", 3, "llm", "b", "q", 2, 4, "LOW", "e", ""), ("r2", 1, "s", "a", "p", 1, 1, "SUPPRESS", "d", "")]
    f = spark.createDataFrame(rows, "run string, ord long, source string, rule_id string, path string, start_line int, end_line int, severity string, description string, fingerprint string")
    docs = {r.run: json.loads(r.sarif) for r in sarif.encode(f).collect()}
    one = docs["r1"]["runs"][0]
    assert [x["id"] for x in one["tool"]["driver"]["rules"]] == ["llm/a", "llm/b"] and [x["level"] for x in one["results"]] == ["error", "note"]
    loc = [x["locations"][0]["physicalLocation"] for x in one["results"]]
    assert "region" not in loc[0] and loc[1]["region"] == {"startLine": 2, "endLine": 4} and docs["r2"]["runs"][0]["results"] == []
    assert sarif.violations(sarif.encode(f)).count() == 0
    bad = spark.createDataFrame([("x", '{"version": "2", "runs": [{"results": [{"level": "bad"}]}]}')], "run string, sarif string")
    assert {r.violation for r in sarif.violations(bad).collect()} == {"version", "ruleId", "level"}


def test_continuous_reconciliation(spark, tmp_path):
    schema = "owner string, repo string, pr long, fingerprint string, path string, ord long, seen long"
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("o", "r", 1, "a", "p", 1, 10), ("o", "r", 1, "b", "q", 2, 10)], schema).write.parquet(src)
    run = lambda: reconcile_stream(spark.readStream.schema(schema).parquet(src), state, str(tmp_path / "cp"))
    q = run()
    q.processAllAvailable()
    spark.createDataFrame([("o", "r", 1, "c", "p", 3, 20), ("o", "r", 1, "a", "p", 1, 20)], schema).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {r.fingerprint: (r.state, r.first_seen, r.last_seen) for r in current_state(spark, state).collect()}
    assert got == {"a": ("keep", 10, 20), "b": ("carried", 10, 20), "c": ("new", 20, 20)}
    assert current_state(spark, state).agg(F.max("batch")).first()[0] >= 1


def test_continuous_state_is_compacted(spark, tmp_path):
    schema = "owner string, repo string, pr long, fingerprint string, path string, ord long, seen long"
    src, state = str(tmp_path / "in"), tmp_path / "state"
    push = lambda k: spark.createDataFrame([("o", "r", k % 3, f"f{k}", "p", k, k), ("o", "r", k % 3, "all", f"q{k}", k, k)], schema).coalesce(1)
    push(0).write.parquet(src)
    q = reconcile_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), str(state), str(tmp_path / "cp"), compact_every=2)
    q.processAllAvailable()
    for k in range(1, 7):
        push(k).write.mode("append").parquet(src)
        q.processAllAvailable()
    q.stop()
    folders = sorted(f.name for f in state.iterdir())
    assert [f for f in folders if f.startswith("snapshot")] == ["snapshot=000000000004", "snapshot=000000000006"] and len([f for f in folders if f.startswith("version")]) <= 4
    got = {(r.pr, r.fingerprint): (r.state, r.first_seen) for r in current_state(spark, str(state)).collect()}
    assert got == {(0, "f6"): ("new", 6), (0, "all"): ("keep", 0), (1, "f4"): ("new", 4), (1, "all"): ("keep", 1), (2, "f5"): ("new", 5), (2, "all"): ("keep", 2)}


def test_govulncheck(spark):
    step = lambda file, line, module="m": {"module": module, "package": "p", "function": "F", "position": {"filename": file, "line": line}}
    found = lambda osv, *trace: json.dumps({"finding": {"osv": osv, "trace": list(trace)}})
    body = "\n".join(
        [
            json.dumps({"osv": {"id": "V1", "summary": "bad"}}, indent=1) + found("V1", step("src/lib.go", 1, "x"), step("/root/a.go", 3)),
            "{broken", found("V1", step("/root/a.go", 3)), found("V2", {"module": "m"}, step("b.go", 4)), found("V3", step("/usr/c.go", 5, "x")), found("V4"),
        ]
    )
    streams = spark.createDataFrame([(1, body), (2, body), (3, None)], "report_id long, body string")
    roots = spark.createDataFrame([(1, "/root", "m"), (2, "/root", None), (3, "/", "m")], "report_id long, root string, module string")
    got = sorted((r.report_id, r.rule_id, r.path, r.line, r.description, r.evidence) for r in reports.govulncheck_findings(reports.json_messages(streams), roots).collect())
    assert got == [(i, *r) for i in (1, 2) for r in (("V1", "a.go", 3, "bad", "p.F"), ("V2", "b.go", 4, "V2", "p.F"))]


def plain_hunk_lines(text):
    file_no = hunk_no = 0
    for pos, line in enumerate(text.split("\n")):
        if re.match(r"diff --git a/.+ b/.+$", line):
            file_no, hunk_no = file_no + 1, 0
        elif file_no and re.match(r"@@ -\d", line):
            hunk_no += 1
            m = re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
            old, new = (int(m[1]), int(m[2])) if m else (None, None)
        elif hunk_no and not line.startswith("\\ "):
            kind = {"+": "added", "-": "deleted"}.get(line[:1], "context")
            at = [n if kind != other else None for n, other in ((old, "added"), (new, "deleted"))]
            yield file_no, hunk_no, pos, kind, line[1:] if line[:1] in ("+", "-", " ") and line else line, *at
            if m:
                old, new = old + (kind != "added"), new + (kind != "deleted")


def test_diffs_of_any_form_are_cut_within_their_row(spark):
    rng = random.Random(3)
    some = ["diff --git a/x b/y", "@@ -3,4 +7 @@ f", "@@ -1", "@@ -9 +2,2 @@", "+a", "-b", " c", "", "+++i", "\\ No newline", "index 1..2", "text"]
    texts = ["\n".join(rng.choices(some, k=rng.randrange(40))) for _ in range(150)]
    texts.append("diff --git a/x b/y\n@@ -1 +1 @@\n" + "\n".join(rng.choices(["+a", "-b", " c"], k=1000)))  # many chunks
    d = spark.createDataFrame(list(enumerate(texts)), "diff_id long, text string")
    got = {(r.diff_id, r.file_no, r.hunk_no, r.pos, r.type, r.content, r.old_line, r.new_line) for r in diffs.hunk_lines(d).collect()}
    assert got == {(k, *row) for k, t in enumerate(texts) for row in plain_hunk_lines(t)}
    counts = {(r.diff_id, r.file_no): (r.insertions, r.deletions) for r in diffs.file_changes(d).collect()}
    assert sum(a for a, _ in counts.values()) == sum(r[4] == "added" for r in got) and sum(b for _, b in counts.values()) == sum(r[4] == "deleted" for r in got)
    for table in (diffs.file_changes(d), diffs.hunk_lines(d)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Aggregate")), plan
