"""Pairs of overlapping change sets against a plain search over all pairs."""

import json
import random

import pytest

from tidemark.operators import overlap
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def plain_pairs(prs, threshold):
    out = {}
    for r, a, title_a, paths_a, symbols_a in prs:
        for s, b, title_b, paths_b, symbols_b in prs:
            if r == s and a < b:
                w, v = set((title_a or "").lower().split()), set((title_b or "").lower().split())
                similarity = len(w & v) / len(w | v) if w and v else 0.0
                shared = sorted(set(paths_a or ()) & set(paths_b or ()))
                if shared or set(symbols_a or ()) & set(symbols_b or ()) or similarity >= threshold:
                    out[r, a, b] = (similarity, tuple(shared))
    return out


@pytest.mark.parametrize("block,threshold", [(1024, 0.4), (3, 0.4), (2, 0.8)])
def test_overlaps_equal_a_plain_search(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(5)
    words, long_list = "fix the a cache lock test build log new drop".split(), [f"copied/{k}" for k in range(30)]
    prs = [(rng.choice("xy"), k, " ".join(rng.choices(words, k=rng.randrange(7))), rng.sample([f"p{i}" for i in range(40)], rng.randrange(4)), [f"s{k % 9}"] * (k % 2)) for k in range(60)]
    prs += [("x", 100 + k, "Release", ["hot", *long_list], []) for k in range(7)] + [("x", 200, None, None, None), ("y", 201, "", ["hot", "hot"], ["s1"]), ("x", 202, "release", ["hot"], [])]
    rng.shuffle(prs)
    df = spark.createDataFrame(prs, "repo string, number long, title string, paths array<string>, symbols array<string>")
    want = plain_pairs(prs, threshold)
    got = overlap.overlap_candidates(df, threshold).collect()
    assert len(got) == len(want)
    assert {(r.repo, r.a, r.b): (r.title_similarity, tuple(r.shared_paths)) for r in got} == want
    got = overlap.overlap_pairs(df, threshold).collect()
    assert len(got) == len(want)
    assert {(r.repo, r.a, r.b): (r.title_similarity, r.n_shared) for r in got} == {k: (s, len(p)) for k, (s, p) in want.items()}


def test_sets_of_many_ids_equal_a_plain_search(spark):
    """More words and paths than a set has bits for, and classes of so many paths that each kind of their number is needed."""
    rng = random.Random(11)
    words, paths = [f"w{k}" for k in range(700)], [f"p{k}" for k in range(700)]
    some = lambda of, n: [of[int(len(of) * rng.random() ** 2)] for _ in range(n)]
    prs = [(rng.choice("xy"), k, " ".join(some(words, rng.randrange(30))), some(paths, rng.randrange(25)), some(["s1", "s2", *paths[:40]], k % 2)) for k in range(160)]
    prs += [("x", 200 + k, " ".join(some(words, 5)), [f"copied/{j}" for j in range((70, 4300)[k % 2])] + some(paths, 3), []) for k in range(6)]
    df = spark.createDataFrame(prs, "repo string, number long, title string, paths array<string>, symbols array<string>")
    for d, rows in ((df, prs), (df.drop("symbols"), [(*p[:4], []) for p in prs])):
        got = overlap.overlap_pairs(d).collect()
        want = plain_pairs(rows, 0.4)
        assert len(got) == len(want) and {(r.repo, r.a, r.b): (r.title_similarity, r.n_shared) for r in got} == {k: (s, len(p)) for k, (s, p) in want.items()}
    assert max(len(p) for _, p in want.values()) >= 4300


@pytest.mark.parametrize("name", ["gated_pairs", "overlap_candidates"])
def test_pairs_are_counted_in_one_compiled_loop(spark, name):
    """No step between a join and the result falls out of the compiled stage, which would write a wide row for each pair."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.split("\n")
    joins = [k for k, x in enumerate(lines) if "SortMergeJoin" in x]
    assert len(joins) == 2
    for k in joins:
        assert "*(" in lines[k] and "*(" in lines[k - 1] and "Project" in lines[k - 1], plan


def test_what_is_shuffled_grows_with_the_memberships(spark, monkeypatch):
    """A hot path has as many blocks as its share of the work asks for, not one more for each so many change sets."""
    monkeypatch.setattr(overlap, "BLOCK", 2)
    monkeypatch.setattr(overlap, "PAIR_TASKS", 1)
    sent = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "repartition", lambda df, *a, own=kind.repartition: (sent.append(df), own(df, *a))[1])
    df = spark.createDataFrame([("x", k, f"t{k}", ["hot", f"p{k // 2}"]) for k in range(300)], "repo string, number long, title string, paths array<string>")
    assert overlap.overlap_pairs(df).count() == 300 * 299 // 2
    assert sum(x.count() for x in sent) <= 600 * 12


@pytest.mark.parametrize("name", ["gated_pairs", "overlap_by_symbols", "overlap_candidates"])
def test_pairs_are_not_shuffled(spark, name):
    """Only change sets are; what the joins yield is the result."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("SortMergeJoin")[0] and plan.count("SortMergeJoin") == 2, plan


def test_recent_overlaps_deal_a_large_repository(spark, monkeypatch):
    """Every part of a repository meets the latest change sets, and no group holds more than its part."""
    monkeypatch.setattr(overlap, "PART", 10, raising=False)
    rng = random.Random(8)
    prs = [("xxxy"[k % 4], k, rng.choice(["fix a", "fix b c", "new", ""]), rng.sample("pqrst", rng.randrange(3)), []) for k in range(120)]
    df = spark.createDataFrame(prs, "repo string, number long, title string, paths array<string>, symbols array<string>")
    late = {r: set(sorted((n for s, n, *_ in prs if s == r), reverse=True)[:4]) for r in "xy"}
    want = {}
    for (r, a, b), v in plain_pairs(prs, 0.4).items():
        want |= {(r, c, d): v for c, d in ((a, b), (b, a)) if d in late[r]}
    out = overlap.recent_overlaps(df, limit=3)
    got = out.collect()
    assert len(got) == len(want) and {(r.repo, r.a, r.b): (r.title_similarity, tuple(r.shared_paths)) for r in got} == want
    assert "repo#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "part#" in plan


@pytest.mark.parametrize("block", [1024, 3])
def test_lists_hold_each_pair_once(spark, monkeypatch, block):
    """One list, so one reply, answers for many pairs, however the change sets of a path are dealt."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "PAIR_TASKS", 1)
    rng = random.Random(3)
    prs = [(rng.choice("xy"), k, rng.choice(["fix a b", "fix b c d", "new", ""]), ["hot", *rng.sample("pqrstuvw", rng.randrange(4))][k % 3 // 2 :], []) for k in range(120)]
    df = spark.createDataFrame(prs, "repo string, number long, title string, paths array<string>, symbols array<string>")
    lists = [r for r in overlap.overlap_lists(df).collect() if r.others]
    pairs = [(r.repo, r.a, b) for r in lists for b in r.others]
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(plain_pairs(prs, 0.4))
    assert len(lists) < len(pairs) / (3 if block == 1024 else 1)


def test_best_verdicts_are_those_of_all(spark):
    rng = random.Random(6)
    kinds = ["both", "merge_conflict", "duplicate_effort", "none", "odd", None]
    replies = []
    for a in range(6):
        said = [{"pr_number": rng.choice([*range(10, 30), 99, None]), "kind": rng.choice(kinds), "confidence": rng.choice([0.2, 0.6, 0.7, 0.95, 1.7, None])} for _ in range(60)]
        replies.append(("x", a % 3, list(range(10, 30)), f"<think>{{no}}</think>```json\n{json.dumps({'overlaps': said})}\n```"))
    replies += [("x", 7, [10], "nothing"), ("x", 8, [], None), ("x", 9, [10], '{"overlaps": []}')]
    d = spark.createDataFrame(replies, "repo string, a long, others array<long>, reply string")
    asked = overlap.parsed_verdicts(d).where("array_contains(others, pr_number)").withColumnRenamed("pr_number", "b")
    cols = ["repo", "a", "b", "kind", "confidence"]
    want = overlap.ranked_overlaps(overlap.kept_verdicts(asked), cap=5).select(*cols, "rank").collect()
    got = overlap.ranked_overlaps(overlap.best_verdicts(d, cap=5), cap=5).select(*cols, "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 15
