"""Streams against the same work in one batch, and against plain versions."""

import json
import random
from collections import defaultdict

import pytest

from tidemark.operators import findings, sessions
from tidemark.streaming.continuous import current_state, reconcile_stream
from tidemark.streaming.sessions import closed_sessions, session_records

SCHEMA = "owner string, repo string, pr long, push long, fingerprint string, path string, ord long, seen long"
STATE = "owner string, repo string, pr long, fingerprint string, path string, ord long, first_seen long, last_seen long, push long"


def plain_fold(rows):
    """Push by push, as a reviewer's tool would."""
    sets = defaultdict(lambda: defaultdict(list))
    for owner, repo, pr, push, *rest in rows:
        sets[owner, repo, pr][push].append(rest)
    out = set()
    for key, pushes in sets.items():
        state = {}
        for _, found in sorted(pushes.items()):
            now, changed = max(x[3] for x in found), {x[1] for x in found}
            fresh = {}
            for fp, path, ord_, seen in sorted(found, key=lambda x: x[2] or 0):
                if fp is not None:
                    fresh[fp] = (path, ord_, "keep" if fp in state else "new", state[fp][3] if fp in state else seen, seen)
            for fp, (path, ord_, _, first, _) in state.items():
                if fp not in fresh and path not in changed:
                    fresh[fp] = (path, ord_, "carried", first, now)
            state = fresh
        out |= {(*key, fp, *v) for fp, v in state.items()}
    return out


def pushes_of(seed, n=40):
    rng, rows = random.Random(seed), []
    for pr in range(6):
        for push in range(rng.randint(1, n)):
            when = 1000 * pr + 10 * push
            names = rng.sample(range(8), rng.randint(0, 4))
            rows += [("o", f"r{pr % 2}", pr, push, f"f{k}", f"p{k % 4}", 100 * push + k, when) for k in names]
            if not names or rng.random() < 0.3:
                rows.append(("o", f"r{pr % 2}", pr, push, None, rng.choice(["p0", "p1", None]), None, when))
    return rows


def state_rows(df):
    return {tuple(r) for r in df.select("owner", "repo", "pr", "fingerprint", "path", "ord", "state", "first_seen", "last_seen").collect()}


def test_two_pushes_in_one_batch(spark):
    rows = [("o", "r", 1, 100, "f1", "a", 1, 100), ("o", "r", 1, 100, "f2", "b", 2, 100), ("o", "r", 1, 200, "f1", "a", 1, 200)]
    none = spark.createDataFrame([], STATE)
    assert state_rows(findings.reconcile_pushes(none, spark.createDataFrame(rows, SCHEMA))) == {
        ("o", "r", 1, "f1", "a", 1, "keep", 100, 200), ("o", "r", 1, "f2", "b", 2, "carried", 100, 200),
    }
    gone = [*rows, ("o", "r", 1, 200, None, "b", None, 200)]
    assert {r[3] for r in state_rows(findings.reconcile_pushes(none, spark.createDataFrame(gone, SCHEMA)))} == {"f1"}


@pytest.mark.parametrize("seed", range(3))
def test_all_pushes_at_once_equal_one_by_one(spark, seed):
    rows = pushes_of(seed)
    got = findings.reconcile_pushes(spark.createDataFrame([], STATE), spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert state_rows(got) == plain_fold(rows)


@pytest.mark.parametrize("seed", range(2))
def test_stream_equals_batch_for_any_split(spark, tmp_path, seed):
    rng, rows = random.Random(seed + 50), pushes_of(seed + 50, 12)
    cuts = {pr: sorted(rng.choices(range(13), k=3)) for pr in range(6)}
    parts = defaultdict(list)
    for r in rows:
        parts[sum(r[3] >= c for c in cuts[r[2]])].append(r)
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    run = lambda: reconcile_stream(spark.readStream.schema(SCHEMA).parquet(src), state, str(tmp_path / "cp"), compact_every=3, available_now=True).awaitTermination()
    for k in sorted(parts):
        spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run()
    want = plain_fold(rows)
    assert state_rows(current_state(spark, state)) == want
    spark.createDataFrame(rng.sample(rows, 20), SCHEMA).coalesce(1).write.mode("append").parquet(src)  # old pushes come again
    run()
    assert state_rows(current_state(spark, state)) == want


def log(session, minute, kind, **fields):
    return {"type": kind, "sessionId": session, "timestamp": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", **fields}


def test_closed_sessions_yield_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    call = lambda s, m, p, ok=True: log(s, m, "tool_call", filePath=p, ok=ok)
    used = lambda s, m, n: log(s, m, "llm_response", usage={"prompt_tokens": n})
    files = [
        [used("a", 0, 5), call("a", 1, "x"), call("a", 2, "x", False), used("b", 1, 7)],  # both open
        [call("a", 3, "y"), log("a", 4, "session_end"), call("b", 5, "z")],  # a ends
        [used("a", 5, 100), used("c", 30, 1)],  # a has yielded: its rest is left out
        [used("d", 300, 2), log("d", 301, "session_end")],  # b and c are idle by now
        [used("a", 310, 9), log("a", 311, "session_end"), used("c", 20, 50)],  # a begins anew; c's row is late
        [used("e", 600, 4)],
    ]
    out = str(tmp_path / "out")
    seen = []
    for k, rows in enumerate(files):
        (folder / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "broken\n")
        q = closed_sessions(session_records(spark, str(folder)), gap="1 hour", delay="10 minutes").writeStream.format("parquet").option("path", out)
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        now = {tuple(r) for r in spark.read.parquet(out).select("session", "prompt_tokens", "tool_calls", "tool_failures", "n_files", "closed").collect()} if k else set()
        seen.append(now - set().union(*seen) if seen else now)
    assert seen == [set(), {("a", 5, 3, 1, 2, True)}, set(), {("d", 2, 0, 0, 0, True), ("b", 7, 1, 0, 1, False), ("c", 1, 0, 0, 0, False)}, {("a", 9, 0, 0, 0, True)}, set()]


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    rng, lines = random.Random(5), []
    for s in range(30):
        n = rng.randint(1, 12)
        rows = [log(f"s{s}", s + k, rng.choice(["llm_response", "tool_call", "llm_error"]), filePath=rng.choice(["", "p", "q", f"p{k}"]), ok=rng.random() < 0.7, usage={"completion_tokens": k, "cache_read_tokens": 2}) for k in range(n)]
        lines.append([*rows, log(f"s{s}", s + n, "session_end")])
    folder = tmp_path / "logs"
    folder.mkdir()
    for k, rows in enumerate(lines):  # the end comes last, or with all the rest
        (folder / f"{k:03d}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    q = closed_sessions(session_records(spark, str(folder), files_per_batch=7)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = sessions.usage_totals(sessions.records(spark.read.text(str(folder))))
    got = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 30


def test_a_session_call_gets_one_column_of_facts(spark):
    """Twelve columns were converted for each session's call."""
    recs = spark.readStream.format("rate").load().selectExpr(
        "'s' AS session", "timestamp AS event_time", "'tool_call' AS type", "'f' AS filePath", "true AS ok",
        "named_struct('prompt_tokens', 1L, 'completion_tokens', 1L, 'cache_read_tokens', 1L, 'cache_write_tokens', 1L) AS usage",
    )
    plan = closed_sessions(recs)._jdf.queryExecution().analyzed().toString()
    assert "AS facts" in plan and "AS prompt_tokens#" not in plan.split("AS facts")[1].split("\n")[0], plan
