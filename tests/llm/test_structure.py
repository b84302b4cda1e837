"""Conversation repair, hard negatives and host rules against plain versions of their own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, hosts, negatives

EXTRA = ("n", "fault", "part", "block", "row", "id", "x", "label_", "host_key", "words", "lines", "verdict", "report", "kind", "e_turn")


def plain_repair(rows):
    """Cheapest edits by a row-by-row search over (position, last initial), whole strings compared."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    moves = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    whole = {"u": "user", "a": "assistant"}

    def closed(states):  # any insertions here
        out, todo = dict(states), list(states.items())
        while todo:
            st, (cost, audit, lines) = todo.pop()
            for c in "ua":
                if (st, c) in moves:
                    new = (cost + 3, audit + "I", (*lines, f"{whole[c]}:"))
                    if c not in out or new[:2] < out[c][:2]:
                        out[c] = new
                        todo.append((c, new))
        return out

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for st, (cost, audit, lines) in closed(states).items():
            ways = [(st, 4, "D", ())]
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                ways += [(c, 3 + extra, "R", (f"{whole[c]}:{text}",)) for c in "ua" if (st, c) in moves]
                if (st, role[:1]) in moves:
                    ways.append((role[:1], extra, "K", (f"{role}:{text}",)))
            for to, c, edit, line in ways:
                got = (cost + c, audit + edit, lines + line)
                if to not in new or got[:2] < new[to][:2]:
                    new[to] = got
        states = new
    cost, audit, lines = min(v for st, v in closed(states).items() if st in ("", "a"))
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    c = Counter(faults)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, c["blank"], c["duplicate"], c["truncated"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversation_table(spark, rows):
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return d.select("*", *[F.lit("own").alias(c) for c in EXTRA]).repartition(3)


def report_rows(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 3])
def test_repair_equals_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    texts = ["Yes.", "No!", "what", "", " \t", "ok?  ", "cut off, ", "Sure. Then"]
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 14)):
            turn = rng.choice([t, t, t, 2 * t, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice([*texts, None, f"text {c} {t}."])))
    rows += [(900, t, "user" if t % 2 else "assistant", f"line {t % 7}.") for t in range(200)]
    rows += [(901, 5, "user", "copy")] * 40
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, " " if r is None else r, " " if x is None else x))
    d = conversation_table(spark, rows)
    got = report_rows(conversations.repair_report(d, conversation_table(spark, [(77_000, 1, "user", "gone")])))
    assert got.pop(77_000) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain_repair(r) for c, r in want.items()}


def test_repaired_rows_are_what_the_digest_covers(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Hm.", f"a {t}", ""])) for c in range(20) for t in range(rng.randint(1, 9))]
    d = conversation_table(spark, rows)
    by = defaultdict(list)
    for r in conversations.repaired_rows(d).orderBy("conv_id", "position").collect():
        by[r.conv_id].append(r)
    for c, r in report_rows(conversations.repair_report(d)).items():
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in by[c]).encode()).hexdigest() == r[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in by[c])) and [x.position for x in by[c]] == list(range(1, len(by[c]) + 1))


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "A. b? c!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            want += [(c, t, "user" if k == 4 else role, "" if k == 1 else "A b c" if k == 2 else text)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in conversations.damaged(conversation_table(spark, rows)).collect()]
    assert Counter(got) == Counter(want)


def test_rules_only_shorten_the_work(spark):
    rng = random.Random(11)
    letters = [conversations.symbol(i, f) for i in conversations.INITIALS for f in conversations.FAULTS]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(80)] + [(letters[4] + letters[8]) * 300]
    d = spark.createDataFrame([(t,) for t in texts], "symbols string")
    pairs = conversations.learn_pairs(d, rounds=9)
    assert len(pairs) > 10 and len(conversations.compress(texts[-1], pairs)) < 40
    plain, rules = conversations.rule_table([]), conversations.rule_table(pairs)
    for t in texts:
        assert conversations.repair([conversations.compress(t, pairs)], rules) == conversations.repair([t], plain)
        halves = [conversations.compress(x, pairs) for x in (t[:7], t[7:20], t[20:])]
        assert conversations.repair(halves, rules) == conversations.repair([t], plain)


def test_empty_conversations(spark):
    d = conversation_table(spark, [(1, 1, "user", "x")]).limit(0)
    assert conversations.repair_report(d, d).count() == 0 and conversations.repaired_rows(d).count() == 0
    assert conversations.damaged(d).count() == 0


def plain_negatives(rows, every=100, positives=5, k=10):
    ok = [(i, v, lab, [math.floor(256 * x) for x in vec]) for i, (v, vec, lab) in enumerate(rows) if lab is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, v, lab, a in ok:
        if v is None or v % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, c, strict=True)), w, m) for j, w, m, c in ok if j != i and len(c) == len(a)]
        for p in sorted((s for s in scored if s[2] == lab), key=key)[:positives]:
            found = sorted((s for s in scored if s[2] != lab and 30 * p[0] <= 100 * s[0] <= 90 * p[0]), key=key)[:k]
            out += [(v, p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1.5e6])
def test_negatives_equal_all_pairs(spark, scale):
    rng = random.Random(int(scale))
    rows = []
    for i in range(400):
        base = rng.choice([0.1, 0.5, 1.0])
        rows.append((i, [scale * (base + rng.gauss(0, 0.4)) for _ in range(12)], rng.randint(0, 3)))
    rows += [(100, rows[3][1], 1), (100, rows[3][1], 1), (100, rows[5][1], 2), (7_000, rows[3][1], 0)]  # an id three times over
    rows += [(2_000 + i, rows[8][1], i % 2) for i in range(60)]  # a group of equal vectors
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [float("nan")] * 12, 1), (800, [1.0] * 12, None), (None, rows[9][1], 1), (None, rows[9][1], 2)]
    rows += [(900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (902, [0.5, 1.0], 2), (1_000, [], 1), (1_001, [], 1), (1_002, [], 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("own").alias(c) for c in EXTRA]).repartition(5)
    got = Counter(tuple(r) for r in negatives.hard_negatives(d, shard_components=900, anchor_components=50, fan_in=2).collect())
    want = plain_negatives(rows)
    assert got == want and len(want) > 100
    assert negatives.hard_negatives(d.limit(0)).count() == 0


def test_a_scan_prunes_before_its_end():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(0, 100, (32, 5000)).round()
    q = np.concatenate([rng.normal(0, 2000, 8), rng.normal(0, 1, 24)]).round()
    seen = []
    keep = negatives.above_kth(10)

    def counted(low, high):
        out = keep(low, high)
        seen.append(int(out.sum()))
        return out

    at, sums = negatives.vertical_scan(q, negatives.Columns(x, np.arange(5000)), np.ones(5000, bool), counted)
    best = np.argsort(-(q @ x), kind="stable")[:10]
    assert set(best) <= set(at) and dict(zip(at, sums, strict=True))[best[0]] == (q @ x)[best[0]] and seen[0] < 2500


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_host_rules_equal_a_plain_version(spark):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = []
    for i in range(600):
        host = rng.choice([f"h{i % 12}", "hot", None])
        text = words(rng.randint(21, 60))
        if host == "h1" or rng.random() < 0.1:
            text = rng.choice([words(5), " ".join([words(9)] * 5)])
        if host == "h2" and rng.random() < 0.6 or rng.random() < 0.05:
            text = "\n".join([words(6)] * 3 + [words(60) + " # $ * & % <b>"])
        rows.append((i, text, host))
    rows += [(1000, None, None), (1001, "", "h3"), (1002, " \x0b\n\x0c\r\t", "hot"), (1003, "\x85a\xa0b", "h4"), (1004, "é😀 " * 25, "h5"), (None, words(30), "h6"), (7, rows[7][1], rows[7][2])]
    rows += [(2000, " ".join(f"u{i}" for i in range(40_000)), "h7"), (2001, words(8), "alone"), (2002, "a b c d e f g h " * 3000, "h8")]
    stats = [plain_statistics(t) for _, t, _ in rows]
    base = [w < 20 or 100 * r > 30 * w for w, _, _, _, _, r in stats]
    soft = [10 * s > w or 10 * dup > 3 * n for w, _, s, n, dup, _ in stats]
    by = defaultdict(list)
    for (_, _, h), b, s in zip(rows, base, soft, strict=True):
        by[h].append((b, b or s))
    verdict = {}
    rates, means = {}, []
    for k in (0, 1):
        total, failed = sum(map(len, by.values())), sum(x[k] for v in by.values() for x in v)
        m = failed / total
        means.append(m)
        dev = sum(len(v) * (sum(x[k] for x in v) / len(v) - m) ** 2 for v in by.values())
        spread = total - sum(len(v) ** 2 for v in by.values()) / total - (len(by) - 1)
        rho = min(max((dev / (m * (1 - m)) - (len(by) - 1)) / spread, 1e-6), 1 - 1e-6)
        strength = (1 - rho) / rho
        rates[k] = {h: (sum(x[k] for x in v) + m * strength) / (len(v) + strength) for h, v in by.items()}
    for h in by:
        verdict[h] = "blocked" if rates[0][h] >= 0.5 else "strict" if rates[1][h] >= max(0.25, 2 * means[1]) else "trusted"
    assert verdict["h1"] == "blocked" and verdict["h2"] == "strict" and verdict["alone"] == verdict["hot"] == "trusted"
    want = Counter(
        (i, w, c, s, dup, r, b, not (b or verdict[h] == "blocked" or (verdict[h] == "strict" and so)), h, verdict[h])
        for (i, _, h), (w, c, s, _, dup, r), b, so in zip(rows, stats, base, soft, strict=True)
    )
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("own").alias(c) for c in EXTRA]).repartition(4)
    for limit in (hosts.BROADCAST_HOSTS, 3):
        got = hosts.host_rules(d, broadcast_hosts=limit)
        assert Counter(tuple(r) for r in got.collect()) == want
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert hosts.host_rules(d.limit(0)).count() == 0


def test_a_prior_draws_small_hosts_to_the_mean(spark):
    alike = spark.createDataFrame([(100, 10)] * 30 + [(1, 1)], "n long, base long")
    a, b = hosts.beta_prior(alike, "base")
    assert a + b > 1000 and abs(a / (a + b) - 301 / 3001) < 1e-9
    apart = spark.createDataFrame([(100, 95), (100, 2)] * 10, "n long, base long")
    a, b = hosts.beta_prior(apart, "base")
    assert a + b < 3
    assert hosts.beta_prior(apart.limit(0), "base") == (0.0, 0.0)


def test_what_rounding_leaves_open_is_light():
    from tidemark.llm import mixing

    rng, taken = random.Random(6), Counter()
    items = sorted(((i, float(rng.choice([1, 5, 40, 400])), 0.3) for i in range(120)), key=lambda x: -x[1])
    for seed in range(400):
        done, left = mixing.pivotal(items, seed)
        size = {k: w for k, w, _ in items}
        moved = sum(size[k] for k, c in done if c) + (left[1] * left[2] if left else 0)
        assert abs(moved - 0.3 * sum(size.values())) < 1e-6 and (left is None or left[1] <= 5)
        taken.update(k for k, c in done if c)
    rates = [taken[k] / 400 for k, w, _ in items if w > 5]
    assert abs(sum(rates) / len(rates) - 0.3) < 0.03 and 0.15 < min(rates) and max(rates) < 0.45


def test_mixing_comes_near_small_targets(spark):
    from tidemark.llm import mixing

    rng = random.Random(16)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 40)), f"s{i % 6}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").where("length(text) < 20000")
    got = mixing.mix_report(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.max("size").alias("big")).collect()
    assert all(abs(r.t - r.x) <= 0.03 * r.x for r in got), got
