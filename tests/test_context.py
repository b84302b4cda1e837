"""Rules, budgets and session logs on small cases."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import context, findings, placement, sessions
from tidemark.operators.context import Rule
from tidemark.plans import catalog
from tidemark.streaming.sessions import session_totals

SF = "/root/testdata/sf0.001"


def test_rules(spark):
    c = spark.createDataFrame([("o", "r", 1, "a/b.py"), ("o", "r", 1, "a/c.md"), ("o", "s", 2, None), ("o", "t", 3, "")], "owner string, repo string, pr long, path string")
    rules = [
        Rule("z", "global"), Rule("off", "global", enabled=False), Rule("b", "path", paths=("**/*.py",), exclude=("a/*",)), Rule("c", "path", paths=("**",)),
        Rule("d", "repo", repos=("o/r",), paths=("**/*.go",)), Rule("e", "repo", repos=("o/s",)), Rule("f", "repo"), Rule("g", "odd"),
    ]
    got = sorted((r.pr, r.rank, r.rule_id) for r in context.selected_rules(c, rules).collect())
    assert got == [(1, 1, "z"), (1, 2, "c"), (2, 1, "z"), (2, 2, "e"), (3, 1, "z")]
    assert {r.rule_id for r in context.selected_rules(c, rules, cap=1).collect()} == {"z"}
    assert context.selected_rules(c, []).count() == 0


def test_rules_of_a_table_equal_rules_of_the_plan(spark):
    rng = random.Random(21)
    part = lambda: rng.choice(["src", "a", "b.c", "*", "**", "f?", "x{1,2}", "[ab]", "*.py", "m.py", "**/*.py", ".env"])
    glob = lambda: "/".join(part() for _ in range(rng.randint(1, 3)))
    globs = lambda: tuple(glob() for _ in range(rng.randint(0, 2)))
    rules = [Rule(f"r{k:03d}", rng.choice(["global", "repo", "path", "path", "odd"]), rng.random() < 0.9, rng.choice([(), ("o/r",), ("o/s", "o/r")]), rng.choice([globs(), ("",), globs()]), globs()) for k in range(120)]
    name = lambda: rng.choice(["src", "a", "b.c", "f1", "x1", "m.py", "b", ".env", "n.md"])
    rows = [("o", rng.choice("rst"), k % 9, "/".join(name() for _ in range(rng.randint(1, 4)))) for k in range(60)] + [("o", "t", 50, None), ("o", "t", 51, "")]
    c = spark.createDataFrame(rows, "owner string, repo string, pr long, path string")
    for cap in (1000, 4):
        want = {tuple(r) for r in context.selected_rules(c, rules, cap).collect()}
        assert {tuple(r) for r in context.selected_from_many(c, rules, cap).collect()} == want and len(want) > 20
    assert context.selected_from_many(c, []).count() == 0


def test_first_fit(spark):
    d = spark.createDataFrame([("x", i, n) for i, n in enumerate([6, 5, 4, 20, 3, 5, 0])] + [("y", 0, 1)], "g string, ord long, tokens long")
    got = [(r.g, r.chunk) for r in context.first_fit(d, 10, "g").orderBy("g", "ord").collect()]
    assert got == [("x", 0), ("x", 1), ("x", 0), ("x", 2), ("x", 1), ("x", 3), ("x", 0), ("y", 0)]
    assert sorted(r.chunk for r in context.first_fit(d.where("g = 'x'"), 0, "g").collect()) == list(range(7))
    assert context.first_fit(d.where("false"), 10, "g").count() == 0


def test_first_fit_of_many_items(spark):
    rng = random.Random(30)
    room = context.Rooms()
    plain, limit = [], 100
    for n in (rng.choice([rng.randint(0, 100), 60, 61, 100]) for _ in range(4000)):
        at = next((k for k, t in enumerate(plain) if t + n <= limit), None)
        if at is None:
            plain.append(n)
            assert room.first(n) is None and room.add(limit - n) == len(plain) - 1
        else:
            plain[at] += n
            assert room.first(n) == at
            room.take(at, n)
    d = spark.range(100_000).select(F.lit("x").alias("g"), F.col("id").alias("ord"), (60 + F.col("id") % 37).alias("tokens"))
    began = time.time()
    assert context.first_fit(d, 100, "g").agg(F.max("chunk")).first()[0] == 99_999
    assert time.time() - began < 60


def test_context_falls_back_to_imports(spark):
    key = "owner string, repo string, pr long, "
    sections = spark.createDataFrame([("o", "r", 1, "source", "a.py", 9)], key + "section string, path string, n_bytes long")
    found = spark.createDataFrame([("o", "r", p, 0, k, "m.py", f"i{k}.py", "x = 1\n") for p in (1, 2) for k in range(3)], key + "importer_ord int, ord int, importer string, path string, content string")
    got = {tuple(r)[2:5] for r in context.review_context(sections, found, max_files=2).collect()}
    assert got == {(1, "source", "a.py"), (2, "imported", "i0.py"), (2, "imported", "i1.py")}


def test_token_chunks_equal_brute_force(spark):
    rows = catalog.queries()["token_chunks"](spark, SF).orderBy("owner", "repo", "pr", "ord").collect()
    assert len(rows) > max(r.chunk for r in rows) + 1
    sums = {}
    for r in rows:
        s = sums.setdefault((r.owner, r.repo, r.pr), [])
        fits = [k for k in range(len(s)) if r.tokens <= 5000 and s[k] + r.tokens <= 5000]
        assert r.chunk == (fits[0] if fits else len(s))
        if fits:
            s[fits[0]] += r.tokens
        else:
            s.append(r.tokens)


def test_session_lines(spark):
    lines = [
        (1, '{"type":"review_item_done","sessionId":"s","fingerprint":"f","comments":"a"}'),
        (2, '{"type":"review_item_reused","sessionId":"s","fingerprint":"f"}'),
        (3, '{"type":"review_item_done","sessionId":"s","fingerprint":""}'),
        (4, "not json"), (5, ""), (6, None), (7, '{"type":"tool_call","sessionId":"s","ok":"what"}'), (8, '{"type":"later","sessionId":"s","new":1}'),
    ]
    recs = sessions.records(spark.createDataFrame(lines, "line_no long, value string"))
    assert sorted(r.line_no for r in recs.collect()) == [1, 2, 3, 8]
    assert [tuple(r) for r in sessions.resume_items(recs).collect()] == [("s", "f", "")]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.jsonl").write_text(
            f'{{"type":"llm_response","sessionId":"s{k % 2}","usage":{{"prompt_tokens":{k + 1},"completion_tokens":2}}}}\nbroken\n'
            f'{{"type":"tool_call","sessionId":"s{k % 2}","tool_name":"t","ok":false,"filePath":"p{k}"}}\n{{"type":"session_end","sessionId":"s{k % 2}"}}\n'
        )
    q = session_totals(spark, str(folder), 1).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = sessions.usage_totals(sessions.records(spark.read.text(str(folder))))
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.table("totals").collect()) == key(batch.collect())
    assert key(batch.select("session", "prompt_tokens", "n_files", "closed").collect()) == [("s0", 4, 2, True), ("s1", 2, 1, True)]


def test_text_metrics(spark):
    rows = [("duration=1.5s files=8 files=9 tokens=in:3/out:4 cost=$0.25 findings=new:1/carried:x/resolved:3 comments=2",), ("duration=12ms junk tokens=out:5",), ("duration=5",), ("",)]
    m = [r.m for r in spark.createDataFrame(rows, "p string").select(sessions.text_metrics(F.col("p")).alias("m")).collect()]
    assert (m[0].duration_ms, m[0].files_reviewed, m[0].prompt_tokens, m[0].completion_tokens, m[0].total_cost_usd) == (1500, 9, 3, 4, 0.25)
    assert (m[0].new_findings, m[0].carried_findings, m[0].resolved_findings, m[0].comments_posted, m[0].scanner_findings) == (1, 0, 3, 2, None)
    assert (m[1].duration_ms, m[1].prompt_tokens, m[1].completion_tokens) == (12, None, 5) and m[2].duration_ms == 0 and m[3].duration_ms is None


def test_placement(spark):
    key = ("o", "r", 1)
    hunks = spark.createDataFrame(
        [(*key, 1, 0, p, t, c, o, n) for p, (t, c, o, n) in enumerate([("context", "a", 5, 7), ("deleted", "old", 6, None), ("added", "  b ", None, 8), ("context", "a", 7, 9), ("added", "b", None, 10)])],
        "owner string, repo string, pr long, change_id long, hunk_no int, pos int, type string, content string, old_line int, new_line int",
    )
    contents = spark.createDataFrame([(*key, 1, "x\n\n+ y\nz"), (*key, 2, "only\nhere\nonly"), (*key, 3, None)], "owner string, repo string, pr long, change_id long, content string")
    changes = spark.createDataFrame(
        [(*key, 1, "a0", "a", 1), (*key, 2, "", "b", 2), (*key, 3, "c", "/dev/null", 3)], "owner string, repo string, pr long, change_id long, old_path string, new_path string, ord long"
    )
    cases = {
        1: ("a", "a\nb", 0), 2: ("a0", "+a\n-old", 0), 3: ("a", "x\ny", 0), 4: ("a", "only\nhere", 0), 5: ("a", "absent", 0), 6: ("a", "a", 4),
        7: ("a", " \n", 0), 8: ("nowhere", "z", 0), 9: ("b", "only", 0), 10: ("a", "old\na", 0),
    }
    f = spark.createDataFrame(
        [(k, *key, p, q, s, 0) for k, (p, q, s) in cases.items()], "finding_id long, owner string, repo string, pr long, path string, existing_code string, start_line long, end_line long"
    )
    out = placement.placed(f, changes, placement.side_lines(hunks, contents))
    got = {r.finding_id: (r.path, r.start_line, r.end_line, r.placed_by) for r in out.collect()}
    assert got == {
        1: ("a", 7, 8, "own"), 2: ("a0", 5, 6, "own"), 3: ("a", 1, 3, "own"), 4: ("b", 1, 2, "moved"), 5: ("a", 0, 0, "none"), 6: ("a", 4, 0, "given"),
        7: ("a", 0, 0, "none"), 8: ("a", 4, 4, "moved"), 9: ("b", 1, 1, "own"), 10: ("a", 6, 7, "own"),
    }


def test_runs_of_any_length_are_found(spark):
    rng, key = random.Random(3), ("o", "r", 1)
    files = {c: [rng.choice("abc") if rng.random() < 0.9 else f"line {rng.randint(0, 9)}" for _ in range(rng.randint(1, 60))] for c in range(12)}
    quotes = {}
    for k in range(80):
        lines = files[rng.randrange(12)]
        at, m = rng.randrange(len(lines)), rng.randint(1, 20)
        quotes[k] = lines[at : at + m] + (["x"] if rng.random() < 0.1 else [])
    contents = spark.createDataFrame([(*key, c, "\n".join(x)) for c, x in files.items()], "owner string, repo string, pr long, change_id long, content string")
    hunks = spark.createDataFrame([], "owner string, repo string, pr long, change_id long, hunk_no int, pos int, type string, content string, old_line int, new_line int")
    f = spark.createDataFrame([(k, *key, "p", "\n".join(q), 0, 0) for k, q in quotes.items()], "finding_id long, owner string, repo string, pr long, path string, existing_code string, start_line long, end_line long")
    got = {(r.finding_id, r.change_id): (r.start, r.end) for r in placement.matches_of(f, placement.side_lines(hunks, contents)).collect()}
    want = {}
    for k, q in quotes.items():
        for c, x in files.items():
            at = next((i for i in range(len(x) - len(q) + 1) if x[i : i + len(q)] == q), None)
            if at is not None:
                want[k, c] = (at + 1, at + len(q))
    assert got == want and max(map(len, quotes.values())) > 16


def test_scanner_table(spark):
    f = spark.createDataFrame(
        [(1, 2, "scanner:s", "", "p", 3, "x" * 101), (1, 1, "scanner:t", "c", "q", 0, " a\n b "), (2, 1, "llm", "c", "q", 0, "a")],
        "pr long, ord long, source string, category string, path string, start_line int, content string",
    )
    got = {r.pr: r.table.split("\n")[2:] for r in findings.scanner_table(f, "pr").collect()}
    assert got == {1: ["| t | c | `q:0` | a b |", "| s | - | `p:3` | " + "x" * 97 + "... |", ""]}


def plain_sections(changed, blast, contents, summaries, imports, directories, tokens):
    """The three sections of one change set, one after the other."""
    budget = tokens * 4
    out, used = [], 0
    order = [p for p, n, o in sorted(changed, key=lambda c: (-c[1], c[2]))]
    order += [p for p, n, k in sorted(blast, key=lambda b: (-b[1], b[2], b[0])) if p not in order]
    source = set()
    for p in order:
        room = budget * 60 // 100 - used - 256
        if used >= budget * 60 // 100 or room <= 0 or not contents.get(p):
            continue
        text = contents[p].encode()
        if len(text) > room:
            text = text[:room]
            text = text[: text.rfind(b"\n")] if text.rfind(b"\n") > 0 else text
            text += b"\n// ... (truncated)"
        block = f"#### `{p}`\n```{p.rpartition('.')[2] if '.' in p else ''}\n".encode() + text + b"\n```\n\n"
        if used + len(block) <= budget * 60 // 100:
            used += len(block)
            source.add(p)
            out.append(("source", p, len(block)))
    names = {p for p, _, _ in changed}
    listed = [(0, p) for p in sorted(names - source)] + [(1, t) for t in sorted({t for s, t in imports if s in names} - names - source)]
    total, headed = len("### File summaries\n"), False
    for related, p in listed:
        if not summaries.get(p, "").strip():
            continue
        if related and not headed:
            total += len("\n**Related files (imported by changed files):**\n")
            headed = True
        n = len(f"- `{p}`: {summaries[p]}\n".encode())
        total += n
        if total <= budget * 30 // 100:
            out.append(("summary", p, n))
    total = len("### Directory context\n")
    for p in sorted({p.rpartition("/")[0] for p in names} - {""}):
        if p in directories:
            n = len(f"- `{p}/`: {directories[p][0]} ({directories[p][1]} files)\n".encode())
            total += n
            if total <= budget * 10 // 100:
                out.append(("directory", p, n))
    return out


def test_context_sections_equal_a_plain_version(spark):


    from tidemark.operators import context

    rng = random.Random(4)
    paths = [f"{rng.choice(['a', 'a/b', 'c'])}/f{k}.py" for k in range(30)] + ["Makefile"]
    contents = {p: "\n".join("x" * rng.randint(0, 30) for _ in range(rng.randint(0, 60))) for p in paths}
    summaries = {p: rng.choice(["", "does é things", "a longer summary of it"]) for p in paths}
    imports = [(rng.choice(paths), rng.choice(paths)) for _ in range(60)]
    dirs = {"a": ("dir a", 3), "a/b": ("dir b", 12), "c": ("x" * 80, 1)}
    rows, blasts, want = [], [], []
    for pr in range(6):
        changed = [(p, rng.randint(0, 3), k) for k, p in enumerate(rng.sample(paths, 7))]
        blast = [(p, rng.randint(1, 4), rng.randint(1, 2)) for p in rng.sample(paths, 6)]
        rows += [("o", "r", pr, *c) for c in changed]
        blasts += [("o", "r", pr, *b) for b in blast]
        want += [(pr, *x) for x in plain_sections(changed, blast, contents, summaries, imports, dirs, 900)]
    frame = lambda data, kind: spark.createDataFrame(data, kind)
    got = context.context_sections(
        frame(rows, "owner string, repo string, pr long, path string, n_inbound long, ord long"), frame(blasts, "owner string, repo string, pr long, path string, n_symbols long, depth int"),
        frame([("r", p, c) for p, c in contents.items()], "repo string, path string, content string"), frame([("r", p, s) for p, s in summaries.items()], "repo string, path string, summary string"),
        frame([("r", *i) for i in set(imports)], "repo string, source_path string, target_path string"), frame([("r", p, *v) for p, v in dirs.items()], "repo string, path string, summary string, n_files int"), tokens=900,
    )
    assert sorted((r.pr, r.section, r.path, r.n_bytes) for r in got.collect()) == sorted(want)


def test_sections_take_many_groups_as_one_stream(spark):
    """A Python call for each change set took 10 ms each; a null key is a group too, and limits begin anew."""
    files = spark.createDataFrame(
        [("o", "r", pr, f"f{k}.go", k, "x" * 100) for pr in (1, 2, None) for k in range(5)], "owner string, repo string, pr long, path string, ord int, content string"
    )
    got = context.source_excerpts(files.orderBy(F.desc("ord")), 600)
    assert sorted((r.pr or 0, r.path) for r in got.collect()) == [(pr, f"f{k}.go") for pr in (0, 1, 2) for k in range(3)]
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_excerpts_and_chunks_take_many_groups_as_one_stream(spark):
    rows = [("o", "r", pr, k // 2, k, f"m{k // 2}.go", f"p{k}.go", "x" * 100) for pr in (1, None, 3) for k in range(6)]
    c = spark.createDataFrame(rows, "owner string, repo string, pr long, importer_ord int, ord int, importer string, path string, content string")
    got = context.import_excerpts(c.orderBy(F.desc("ord")), budget=450, max_files=2)
    assert sorted((r.pr or 0, r.path, r.rank) for r in got.where("pr is not null").collect()) == [(pr, f"p{k}.go", k + 1) for pr in (1, 3) for k in range(2)]
    items = c.select("pr", "ord", F.lit(3).cast("long").alias("tokens"), F.lit(3).cast("long").alias("n_bytes"))
    chunks, fit = context.first_fit(items, 6, "pr"), context.fitting_items(items, 10, "pr")
    assert sorted((r.pr or 0, r.ord, r.chunk) for r in chunks.collect()) == [(pr, k, k // 2) for pr in (0, 1, 3) for k in range(6)]
    assert sorted((r.pr or 0, r.ord) for r in fit.collect()) == [(pr, k) for pr in (0, 1, 3) for k in range(3)]
    for d in (got, chunks, fit):
        assert "FlatMapGroups" not in d._jdf.queryExecution().toString()
