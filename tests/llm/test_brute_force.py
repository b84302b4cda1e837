"""Quality, toxicity features, surrogates and near duplicates against plain versions of their own."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import common, dense, fingerprint, neardup, pii, quality, toxicity

WORDS = [f"w{i:03d}" for i in range(200)]


def test_quality_weights_equal_plain_counts(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices(WORDS[: 60 + i], k=rng.randint(0, 40)))) for i in range(120)] + [(500, None), (0, "again")]
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    buckets = 512

    def grams(text):
        w = [xxhash.xxh3_64_intdigest(t) for t in (text or "").lower().split()]
        pairs = [((a * 0x9E3779B97F4A7C15) & (2**64 - 1)) ^ ((b + (a >> 7)) & (2**64 - 1)) for a, b in zip(w, w[1:], strict=False)]
        return [x % buckets for x in w] + [(p ^ (p >> 33)) % buckets for p in pairs]

    raw, target = Counter(), Counter()
    good = {i for i, q in labels if q == 1}
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    size = lambda c: sum(c.values()) + buckets
    ratio = lambda g: math.log((target[g] + 1) / size(target)) - math.log((raw[g] + 1) / size(raw))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.importance_scores(d, lab, buckets=buckets).collect()
    want = sorted((i, round(sum(map(ratio, grams(t))), 6)) for i, t in rows)
    assert sorted((r.doc_id, round(r.log_weight, 6)) for r in got) == want
    noise = [r.gumbel_key - r.log_weight for r in got]
    assert 0.2 < float(np.mean(noise)) < 1.0 and len(set(noise)) == len(noise)
    kept = quality.resample(d, lab, share=0.25, buckets=buckets).collect()
    keys = sorted((r.gumbel_key for r in got), reverse=True)[: round(0.25 * len(rows))]
    assert sorted(r.gumbel_key for r in kept) == sorted(keys)


def test_kth_largest_equals_sorting(spark):
    rng = random.Random(15)
    x = [rng.choice([rng.gauss(0, 1), 3.0, -1e9, 1e9]) for _ in range(5000)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    plain = sorted((v for v in x if v is not None and v == v), reverse=True)
    for k in (1, 2, 777, 2500, len(plain)):
        assert common.kth_largest(df, "x", k, finish=50) == plain[k - 1]
    assert common.kth_largest(df, "x", 0) is None and common.kth_largest(df, "x", len(plain) + 1) is None


def plain_features(text, lexicon):
    words = text.split()
    if not words:
        return [0.0] * len(dense.NAMES)
    weight, you, hidden, keys, inner, shouted = [], [], [], set(), 0, 0
    for raw in words:
        w = re.sub(r"^\W+|\W+$", "", raw)
        low = re.sub(r"^\W+|\W+$", "", raw.lower())
        find = lambda x: max([lexicon.get(x, 0.0)] + [lexicon.get(x[:k] + "~", 0.0) for k in (4, 5) if len(x) > k])
        got, veiled = find(low), False
        if not got and not low.isalpha() and any(c.isalpha() for c in low):
            got = find(low.translate(dense.LOOKALIKE))
            veiled = got > 0
        weight.append(got)
        hidden.append(veiled)
        you.append(low in dense.SECOND_PERSON)
        if got:
            keys.add(low)
        letters, caps = sum(c.isalpha() for c in raw), sum(c.isupper() for c in raw)
        shouted += letters > 2 and caps == letters
        inner += any(c.isalpha() for c in raw) and any(not c.isalpha() and c not in "-'’" for c in w)
    n, hits = len(words), [k for k, w in enumerate(weight) if w]
    near = sum(any(you[max(0, k - 5) : k + 6]) for k in hits)
    count = lambda f: sum(map(f, text))
    run = max((len(m[0]) for m in re.finditer(r"([!?*$%#&@])\1+", text)), default=0)
    return [
        len(hits) / n, sum(weight) / n, len(hits), len(keys), near / n, sum(you) / n, count(str.isupper) / max(1, count(str.isalpha)), shouted / n, text.count("!") / n,
        text.count("?") / n, count(lambda c: not c.isalnum() and not c.isspace()) / len(text), inner / n, sum(hidden) / n, count(str.isdigit) / len(text), run, math.log1p(n),
    ]


LEXICON = {"idiot": 4.0, "idio~": 2.0, "worth~": 3.0, "stupid": 5.0}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("idotIDO0!?1 you@'-é\n\t漢😀$.")), max_size=80))
def test_dense_features_equal_plain_ones(text):
    assert np.allclose(dense.Features(LEXICON)(text), plain_features(text, LEXICON))


def test_dense_features_of_slices(monkeypatch):
    text = "you worthless st0pid thing!! " * 300 + "YOU idiot " * 50 + "x" * 5000
    whole = dense.Features(LEXICON)(text)
    monkeypatch.setattr(dense, "SLICE", 200)
    assert np.allclose(whole, plain_features(text, LEXICON)) and [*dense.slices(text, 200)] != [text] and "".join(dense.slices(text, 200)) == text


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 40), st.integers(1, 40), st.binary(min_size=8, max_size=32), st.text(max_size=5))
def test_permutations_are_permutations(a, b, key, tweak):
    got = [pii.permute(key, tweak, v, a, b) for v in range(a * b)]
    assert sorted(got) == list(range(a * b)) and all(g != v for v, g in enumerate(got))


def test_surrogates_of_a_corpus_are_distinct_and_coreferent(spark):
    rng = random.Random(16)
    values = [f"u{rng.randrange(10**6)}@host{k % 9}.org" for k in range(150)] + [f"10.{k % 4}.{k % 7}.{k}" for k in range(80)] + [f"+1 (555) {rng.randrange(100, 999)}-{k:04d}" for k in range(80)]
    values += [f"Mr. {a} {b}" for a in ("John", "Zorbal", "Kim") for b in ("Smith", "Novak", "Quill")] + [f"Dr. John {b}" for b in ("Smith", "Novak", "Other")]
    texts = [f"see {rng.choice(values)} and {rng.choice(values)} now" for _ in range(900)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings_ = pii.settle(d, "k1")
    out = {r.doc_id: r.text for r in pii.pseudonymize(d, "k1", settings_).collect()}
    pairs = {}
    for i, t in enumerate(texts):
        a, b = (re.match(r"see (.*) and (.*) now$", x).groups() for x in (t, out[i]))
        for x, y in zip(a, b, strict=True):
            pairs.setdefault(x, set()).add(y)
    assert all(len(v) == 1 for v in pairs.values())  # the same entity, the same surrogate, everywhere
    flat = {x: next(iter(v)) for x, v in pairs.items()}
    assert len(set(flat.values())) == len(flat)  # distinct ones stay distinct
    assert all(x != y for x, y in flat.items()) and not {y for x, y in flat.items() if "@" in x} & set(flat)
    name = lambda title, who: flat[f"{title} {who}"].partition(" ")[2]
    assert name("Mr.", "John Smith") == name("Dr.", "John Smith")
    other = {r.doc_id: r.text for r in pii.pseudonymize(d, "k2").collect()}
    assert sum(other[i] != out[i] for i in out) == len(out)


def test_names_take_the_gender_of_the_lists():
    keys = pii.Settings().keys("k")
    ends = lambda text: pii._rewrite(text, keys, 4)[0].split()[1]
    assert ends("Mr. John Smith").endswith("n") and ends("Mrs. Maria Smith").endswith("na") and ends("Dr. Zorbal Smith").endswith("li")
    assert re.fullmatch(r"Frau [А-Яа-я]+на [А-Яа-я]+", pii._rewrite("Frau Анна Петрова", keys, 4)[0])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def labelled(text, k=5):
    w, seen, out = text.lower().split(), Counter(), []
    for i in range(max(1, len(w) - k + 1) if w else 0):
        s = tuple(w[i : i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_alignment_equals_a_plain_longest_common_subsequence(seed):
    rng, shingle = random.Random(seed), neardup.Shingler()
    for _ in range(60):
        a = rng.choices(WORDS[: rng.choice([3, 20, 200])], k=rng.randint(0, 60))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choices(WORDS, k=rng.randint(0, 2))
        x, y = labelled(" ".join(a)), labelled(" ".join(b))
        want = lcs(x, y) / max(len(x), len(y)) if x or y else 1.0
        got = neardup.aligned_similarity(shingle(" ".join(a)), shingle(" ".join(b)))
        assert (got >= 0.8) == (want >= 0.8 - 1e-9) and (got < 0.8 or abs(got - want) < 1e-9)


def test_shared_counts_equal_set_intersections():
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 300, rng.integers(0, 200))).astype(np.uint64) for _ in range(40)]
    got = neardup.shared_counts(texts, columns=64)
    assert all(got[i, j] == len(set(texts[i].tolist()) & set(texts[j].tolist())) for i in range(40) for j in range(40) if i != j)


def test_recall_on_planted_near_copies(spark):
    """Pairs that an exhaustive comparison links, over texts in long near-copy families: at least nine in ten share a class."""
    rng = random.Random(17)
    texts = []
    for _ in range(40):
        base = rng.choices(WORDS, k=rng.randint(60, 250))
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    shingle = neardup.Shingler()
    h = [shingle(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.aligned_similarity(h[i], h[j]) >= 0.8]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cls = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    assert len(linked) > 150 and sum(cls[i] == cls[j] for i, j in linked) >= 0.99 * len(linked)
    assert not any(cls[i] == cls[j] for i in range(len(texts)) for j in range(i) if i // 6 != j // 6)


def test_likeness_of_fingerprints_equals_slot_by_slot(spark):
    rng = random.Random(18)
    texts = ["".join(rng.choices("abcdefg ", k=rng.randint(0, 400))) for _ in range(25)]

    def sketch(text):
        """Least value of each slot over windows, from direct sums instead of prefix arrays."""
        c = [ord(x) + 1 for x in text]
        n, w = len(c), min(16, len(c))
        slots = {}
        for s in range(n - w + 1 if n else 0):
            v = 0
            for p, b in zip(fingerprint.PRIMES, fingerprint.BASES, strict=True):
                v = (v << 31) | sum(x * pow(b, k, p) for k, x in enumerate(c[s : s + w])) % p
            v ^= v >> 33
            v = v * 0xFF51AFD7ED558CCD % 2**64
            v ^= v >> 29
            slots[v & 63] = min(slots.get(v & 63, 2**64), v >> 6)
        if not slots:
            return [255] * 64
        order = sorted(slots)
        return [(slots[next((s for s in order if s >= k), order[0])] >> 11) & 255 for k in range(64)]

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(d).collect()}
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        e = fingerprint.edited(t, nxt)
        like = lambda a, b: 1.0 if a == b else sum(x == y for x, y in zip(sketch(a), sketch(b), strict=True)) / 64
        assert math.isclose(got[i].near_edited, like(t, e)) and math.isclose(got[i].near_next, like(t, nxt))
        same = next((k for k, (x, y) in enumerate(zip(t, e, strict=False)) if x != y), min(len(t), len(e)))
        assert got[i].common_prefix == same
    assert d.count() == len(got) and F is not None


def test_toxicity_ranks_held_out_texts_from_few_labels(spark):
    """About 330 labelled texts, 45 of them toxic, some by mistake: held-out ones must still rank well."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out")
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) >= 0.9 * len(bad) * len(good)
    assert sum(b >= 0.5 for b in bad) >= 0.6 * len(bad) and sum(g >= 0.5 for g in good) <= 0.05 * len(good)


#: Texts and the entities in them, marked by hand.
MARKED = """ISBN 978-3-16-148410-0 and EAN 4006381333931 are no cards||
cards 4845168114407329 and 4845 1681 1440 7329, not 9807915762804490||card 4845168114407329|card 4845 1681 1440 7329
version 1.2.3.4, v10.20.30.40 at 161.17.88.162||ip 161.17.88.162
price 1 234 567 890 or 12 345 678 901 EUR||
llame al 612 345 678, +1 (017) 555-7713||phone 612 345 678|phone +1 (017) 555-7713
Paul Street and Mark Up, then Leon éêé||
Jean de La Fontaine and Maria De Luca met Fontaine||name Jean de La Fontaine|name Maria De Luca|name Fontaine
Mr. Al Gore and Mrs. Van Damme||name Al Gore|name Van Damme
Dr. Ada Stone-Hill, Stone-Hill's, STONE-HILL and Ada Stone||name Ada Stone-Hill|name Stone-Hill|name STONE-HILL|name Ada
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", den.34@mail7.example.com||secret 04dbebab91ab85687d33eeaaf9ac699e1188f962|email den.34@mail7.example.com"""


@pytest.mark.parametrize("line", MARKED.split("\n"))
def test_detection_equals_hand_marked_entities(line):
    text, marks = line.split("||")
    assert [f"{kind} {text[a:b]}" for a, b, kind, _ in pii.entities(text)] == [m for m in marks.split("|") if m]


def test_mentions_of_names_equal_one_alternation():
    rng = random.Random(5)
    given, family = ["Anna", "John", "Maria", "Peter"], ["Stone", "Hill", "Stones", "Smith", "Hill-Stone"]
    for _ in range(300):
        words = rng.choices([*given, *family, "Hill's", "met", "x@Stone.org", "STONE", "Dr. John Hill", "Mrs. Stone", "-Stone", "Stone@"], k=rng.randint(3, 14))
        text = " ".join(words)
        first = [m.span(3) for m in pii._TITLED.finditer(text)] + [m.span(1) for m in pii._KNOWN.finditer(text) if m[2] not in pii.TITLES]
        forms = {f for a, b in first for x in (text[a:b], *text[a:b].split(" ")) for f in (x, x.upper()) if len(f) > 2}
        plain = set(first)
        if forms:
            longest = "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f))))
            plain |= {m.span() for m in re.finditer(rf"(?<![\w@.-])(?:{longest})(?=s?(?![\w@]))", text)}
        got = [(a, b) for a, b, _, _ in pii._named(text, True)]
        covered = lambda spans: {k for a, b in spans for k in range(a, b)}
        assert covered(got) == covered(plain), text


def test_many_names_take_time_by_length():
    text = " ".join(f"Mr. {''.join(chr(97 + int(c)) for c in str(k)).capitalize()}son came." for k in range(10_000, 30_000))
    began = time.time()
    assert len(pii.entities(text)) == 20_000 and time.time() - began < 5
