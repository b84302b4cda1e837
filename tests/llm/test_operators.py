"""Corpus operators against brute force, round trips and edge cases on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, fingerprint, mixing, neardup, packing, pii, quality, tokens, topk, toxicity, urlfilter
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = [f"w{i:03d}" for i in range(400)]
KEY = "a key of the tests"


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(30, 200)) for _ in range(40)]
    near = texts[0].split()
    near[3] = "changed"
    texts += [texts[1], texts[1], " ".join(near), "", None, "one", " \n ", "é́ ßtraße 漢字 " * 50, sentence(rng, 3000)]
    out = [(i * 3, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 0.5) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id here at all", "en", "s1", 1, 0.1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_fingerprints_match_brute_force(docs, rows):
    got = fingerprint.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    seq = ordered(rows)
    want = {}
    for k, r in enumerate(seq):
        t, nxt = r[1] or "", seq[(k + 1) % len(seq)][1] or ""
        n = len(t) // 4
        want.setdefault(r[0], []).append((len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    by = {r[0]: r[1] for r in rows}
    prints = {}
    for r in got:
        prints.setdefault(by[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) == len(prints)


def test_prefix_hashes_answer_extensions():
    h = fingerprint.PrefixHasher()
    a, b = "xxabcdefgh", "abcdeZ"
    x, y = h.prefixes(fingerprint.code_points(a)), h.prefixes(fingerprint.code_points(b))
    assert h.common(x, 2, y, 0) == 5 and h.common(x, 0, y, 0) == 0 and h.equal(x, 3, y, 1, 4)


def test_token_counts_equal_the_library(docs, rows):
    t = tokens.load(tokenizer_path())
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = tokens.count_tokens(docs, tokenizer_path(), chunk=1000, overlap=16).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    odd = ["<|endoftext|>x y" * 9, "a" * 500 + " b " * 50, "it's we'll 12,5 naïve é́x " * 20, "\x1c\x85\u3000 a\tb\r\nc " * 20]
    enc = tokens.WordEncoder(tokenizer_path(), size=20)
    for x in odd:
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode_many([x])[0], "<u4").tolist() == ids
        assert list(tokens.encode_chunked(t, x, 60, 4)) == ids


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode(self, text, **options):
        self.n += len(text)
        return self.tokenizer.encode(text, **options)


def test_long_texts_without_spaces_are_encoded_about_once():
    t, rng = tokens.load(tokenizer_path()), random.Random(6)
    pieces = ["it's ", "we'll", "12", "é\u0301", "ß", "<|endoftext|>", "...", "'", "漢字", "\n", "가", "\u1100", "\u1161"]
    texts = {
        "cjk": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000)), "letters": "".join(rng.choices("abcdefghij", k=300_000)),
        "one": "a" * 300_000, "mixed": "".join(rng.choices(pieces, k=60_000)), "signs": ".!?" * 90_000, "spaces": " " * 300_000, "digits": "123" * 90_000,
    }
    for name, x in texts.items():
        c = Counting(t)
        assert list(tokens.encode_chunked(c, x)) == t.encode(x, add_special_tokens=False).ids, name
        assert c.n < 1.5 * len(x), name


def test_ids_survive_beside_nulls(spark):
    rows = [(2**53 + 1, "one text"), (None, "no id"), (2**53 + 3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r[0] for r in rows}
    assert {r.doc_id for r in tokens.count_tokens(d, tokenizer_path()).collect()} == want
    assert {r.doc_id for r in fingerprint.fingerprint_edits(d).collect()} == want
    assert {r.doc_id for r in packing.pack(d, tokenizer_path()).collect()} == want


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8).astype("float32")]) for i in range(150)]
    bad = [(200, None), (250, [1.0] * 7 + [float("nan")]), (300, [1.0] * 7 + [None]), (50, data[50][1])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>")
    got = topk.top_k(df, query_tile=2, shard_rows=20, fan_in=2).collect()
    # the row that repeats 50 is a candidate and a query of its own
    x = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float))) for i, v in [*data, bad[-1]]]
    want = []
    for at, (q, v) in enumerate(x):
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for k, (c, w) in enumerate(x) if k != at)[:5]
            want += [(q, rank, c, -s) for rank, (s, c) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want) and len(want) == 20
    assert {r.query_id for r in got} == {0, 50, 100}


def test_toxicity_learns_and_keeps_order(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = rng.choices(WORDS, k=80)
        if toxic:
            for _ in range(6):
                w[rng.randrange(80)] = rng.choice(["blorgish", "blorgful", "snarkled"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None), (5000, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(d, lab, trees=5).collect()
    assert len(got) == len(rows)
    held = [(r.predicted, r.doc_id % 6 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(p == int(t) for p, t in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = toxicity.without_toxic(d, lab, trees=5)
    assert kept.columns == d.columns and 740 <= kept.count() <= 770
    assert toxicity.score_toxicity(d, lab.limit(0)).where("predicted = 1").count() == 0


def water_fill(sizes, weights, cap):
    total, open_, fixed = sum(sizes), set(range(len(sizes))), {}
    while open_:
        rest, w = total - sum(fixed.values()), sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > cap * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, rest * weights[i] / w) for i in range(len(sizes))]
        for i in over:
            fixed[i] = cap * sizes[i]
            open_.discard(i)
    return [fixed[i] for i in range(len(sizes))]


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d", None]
    rows = [(i, sentence(rng, rng.randint(0, 60)), rng.choices(names, [9, 1, 4, 4, 2])[0]) for i in range(1500)]
    rows += [(7, rows[7][1], rows[7][2]), (9000, None, "a"), (9001, "", "zero")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1))
    got = mixing.mix_report(d, bucket_rows=16).collect()
    again = mixing.mix_report(d.repartition(7), bucket_rows=16).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted([s for s in size if s is not None]) + [None]
    want = dict(zip(order, water_fill([size[s] for s in order], [(1.0, 2.0, 3.0)[k % 3] for k in range(len(order))], 3.0), strict=True))
    by = {r[0]: r[2] for r in rows}
    taken = {}
    for r in got:
        s = by[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 130 for s in order)
    mixed = mixing.mixed_documents(d, bucket_rows=16)
    assert mixed.columns == d.columns and mixed.select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0] == sum(taken.values())


def test_surrogates_keep_form_and_distinctness(spark):
    texts = ["mail Ann.Lee@Example.com or ann.lee@example.com now", "call +1 (269) 555-1234 or 4111 1111 1111 1111 at 10.20.30.40", "password=b7db7aa4a5fcc78305 and Mrs. Maria Novak met Mr. John Smith",
             "Frau Maria Novak", 'token = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"', "nothing 12 here", None]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, features string")
    out = {r.doc_id: r.text for r in pii.pseudonymize(d, KEY).collect()}
    assert out[6] is None and out[5] == texts[5]
    for i, secret in ((0, "ann.lee"), (1, "269) 555-1234"), (1, "4111 1111"), (1, "10.20.30.40"), (2, "b7db7aa4"), (2, "Novak"), (2, "Smith"), (4, "0cab398d")):
        assert secret.lower() not in out[i].lower()
    a, b = out[0].split()[1], out[0].split()[3]
    assert a.lower() == b and a.endswith(".com") and out[1].startswith("call +1 (")
    assert out[2].split("Mrs. ")[1].split(" met")[0] == out[3].split("Frau ")[1]
    digits = [c for c in out[1].split(" or ")[1].split(" at ")[0] if c.isdigit()]
    assert pii._luhn("".join(digits[:-1])) == int(digits[-1])
    key = b"k" * 32
    assert sorted(pii.permute(key, "t", v, 7, 11) for v in range(77)) == list(range(77)) and all(pii.permute(key, "t", v, 7, 11) != v for v in range(77))
    assert pii.surrogate_report(d, KEY).where("n_entities > 0").count() == 5


PHONES = """+15551234567|5551234567|555-0142|(555) 123-4567|+1 (269) 555-1234|030 1234567|0170-1234567|(030) 1234567|030/1234567|+49 30 1234567|+49 170 1234567
+49 (0)30 1234567|0049 30 1234567|+33 6 12 34 56 78|06 12 34 56 78|0612345678|+34 612 345 678|612 345 678|+34612345678|+44 20 7946 0958"""


@pytest.mark.parametrize("text", PHONES.replace("\n", "|").split("|"))
def test_phone_forms_are_found_whole(text):
    for before, after in (("call ", " now"), ("", "."), ("Tel.: ", ", bitte"), ("llame al ", "")):
        found = pii.entities(before + text + after)
        assert [(a, b, k) for a, b, k, _ in found] == [(len(before), len(before) + len(text), "phone")]
    got = pii.surrogate(b"k" * 32, "phone", text)
    assert got != text and [c.isdigit() for c in got] == [c.isdigit() for c in text]


def test_ipv6_and_things_that_are_no_phones():
    for text in ("2001:db8::8a2e:370:7334", "fe80::1", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "::ffff:10.20.30.40"):
        assert [text[a:b] for a, b, k, _ in pii.entities(text) if k == "ip"] == [text]
        assert pii._address(pii.surrogate(b"k" * 32, "ip", text)) not in (None, pii._address(text))
    assert pii.surrogate(b"k" * 32, "ip", "2001:db8::1") == pii.surrogate(b"k" * 32, "ip", "2001:db8:0:0::1")
    for text in ("on 01.02.2024 and 2024-01-15 12:30", "at 12:30:45 std::vector", "0.1234567 and 1,234,567", "1706000000 ticks"):
        assert not pii.entities(text), text


def test_names_are_coreferent_by_part(spark):
    texts = ["Mrs. Maria Novak came. Novak said so, and Maria Novak wrote; NOVAK's book.", "Dr. Maria del Carmen Lopez and Lopez", "Mr. Smith met Mr. John Smith", "Herr von Braun, Braun", "Nothing by Novak"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymize(d, KEY).collect()}
    first, family = out[0].split()[1:3]
    assert out[0] == f"Mrs. {first} {family} came. {family} said so, and {first} {family} wrote; {family.upper()}'s book."
    for i, names in ((0, "Maria Novak NOVAK"), (1, "Maria Carmen Lopez"), (2, "John Smith"), (3, "Braun")):
        assert not set(names.split()) & set(out[i].replace("'", " ").split())
    w = out[1].split()
    assert w[2] == "del" and w[4] == w[6]
    w = out[2].split()
    assert w[1] == w[5] and out[3].split()[1] == "von" and out[3].split()[2] == out[3].split()[3] + ","
    assert out[4] == texts[4]


def test_packing_round_trip(docs, rows):
    got = packing.pack(docs, tokenizer_path()).collect()
    t = tokens.load(tokenizer_path())
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(t.encode(r[1] or "", add_special_tokens=False).ids + [1])
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(p.length for p in got) == total
    for p in got:
        match = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens]
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in match)
    seq = {}
    for p in got:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    draw = np.random.default_rng(0).lognormal(4, 0.8, 5000).astype(int) % 255
    demand = np.bincount(draw, minlength=256)
    used = packing.integral_patterns(demand, 256)
    assert (sum(p * n for p, n in used) == demand).all() and all(((np.arange(256) + 1) * p).sum() <= 256 for p, _ in used)
    assert sum(n for _, n in used) <= 1.02 * (demand * (np.arange(256) + 1)).sum() / 256 + 1


def brute_classes(texts):
    sh = neardup.Shingler()
    h = [sh(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (len(h[i]) and len(h[j]) and neardup.aligned_similarity(h[i], h[j]) >= 0.8):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    base = [sentence(rng, 120) for _ in range(25)]
    texts = list(base)
    for k in range(60):
        w = base[k % 6].split()
        for _ in range(rng.choice([1, 2, 5, 20])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [base[7]] * 30 + ["", "", "tiny", "  "]
    rng.shuffle(texts)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tid string").repartition(4)
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    want = brute_classes(texts)
    assert len(got) == len(texts)
    pairs = lambda f: {tuple(sorted(v)) for v in _groups(f).values()}
    assert pairs([got[i].class_id for i in range(len(texts))]) == pairs(want)
    kept = neardup.deduplicated(d)
    assert kept.columns == d.columns and kept.count() == len(set(want))
    twice = spark.createDataFrame([(1, base[0]), (1, base[0]), (1, base[1]), (None, base[2]), (None, None)], "doc_id long, text string")
    assert neardup.deduplicated(twice).count() == 4 and neardup.near_duplicates(twice.limit(0)).count() == 0


def test_near_duplicates_of_short_texts_equal_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for n in list(range(8, 21)) * 4 + list(range(30, 50, 2)):
        w = sentence(rng, n + 1).split()
        texts += [" ".join(w[:n]), " ".join(w), " ".join(w[1:]), " ".join(["x", *w[:n], "y"])]
    texts += ["one two three", "One two  three", "one two", "one"]
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    want = brute_classes(texts)
    assert len(set(want)) < len(texts) - 100
    assert set(map(tuple, _groups([got[i] for i in range(len(texts))]).values())) == set(map(tuple, _groups(want).values()))


def _groups(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, []).append(i)
    return out


def test_components_of_long_paths(spark, monkeypatch):
    n, rounds = 3000, []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name, **k: (rounds.append(name), write(df, name, **k))[1])
    ids = [0, *range(n, 0, -1)]
    edges = list(zip(ids, ids[1:], strict=False)) + [(5000, 4999), (5001, 5000)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(ids, 0) | dict.fromkeys((4999, 5000, 5001), 4999)
    assert len(rounds) <= 20


def test_quality_prefers_the_target(spark):
    rng = random.Random(4)
    good = [(i, sentence(rng, 60)) for i in range(200)]
    junk = [(200 + i, " ".join(rng.choices([f"%%{k}" for k in range(50)], k=60))) for i in range(50)]
    d = spark.createDataFrame([*good, *junk, (999, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(200 + i, 0, 0) for i in range(0, 50, 2)], "doc_id long, quality int, toxic int")
    got = [r.doc_id for r in quality.resample(d, lab).collect()]
    assert sum(x < 200 for x in got) >= 195 and sum(200 <= x < 250 for x in got) <= 5
    assert sorted(got) == sorted(r.doc_id for r in quality.resample(d.repartition(3), lab).collect())
    assert sorted(got) == sorted(r.doc_id for r in quality.resample(d, lab, broadcast_ids=0).collect())
    assert quality.resample(d.limit(0), lab).count() == 0


def test_url_filter_edges(spark):
    caps = spark.createDataFrame(
        [(1, "https://a.b.com/x", "2024-02-01"), (2, "https://B.com:80/", "2024-01-01"), (3, None, "2024-01-01"), (4, "https://b.com/", None), (5, "https://u@x.a.b.com.", "2024-03-05")],
        "page_id long, url string, d string",
    ).withColumn("fetched", F.col("d").cast("date"))
    ent = spark.createDataFrame([("b.com", "2024-01-01", "block"), ("b.com", "2024-03-01", "lift"), ("a.b.com", "2024-02-01", "allow"), (None, "2024-01-01", "block")], "domain string, d string, action string")
    got = {r.page_id: (r.matched, r.blocked) for r in urlfilter.temporal_filter(caps, ent.withColumn("day", F.col("d").cast("date"))).collect()}
    assert got == {1: ("a.b.com", False), 2: ("b.com", True), 3: (None, False), 4: (None, False), 5: ("a.b.com", False)}
