"""Odd rows, odd columns and empty tables for every corpus operator and pipeline stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import fingerprint, mixing, neardup, packing, pii, quality, tokens, topk, toxicity, urlfilter
from tidemark.llm.queries import tokenizer_path

KEY = "a key of the tests"
WORDS = [f"w{i:03d}" for i in range(300)]
#: Columns that operators might use themselves, one with a dot in its name.
EXTRA = ("m_own", "m_copy", "k_own", "row", "digest", "tid", "size", "copies", "score", "features", "raw", "vector", "part", "rank", "cls", "h", "noise", "key", "a.b")


def table(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA]).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(5, 80))) for _ in range(30)]
    texts += [None, "", " \n\t", "x" * 70_000, "漢" * 70_000, " ".join(rng.choices(WORDS, k=30_000)), "a", "mail bob@example.com", "\U0001f600é́ " * 40]
    out = [(i * 5, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    twice = [out[0], out[0], (9001, out[1][1], "en", "s1", 3), (9002, out[1][1], "en", "s1", 3)]
    return [*out, *twice, (None, "no id", "en", "s2", 5), (None, None, None, None, None), (2**53 + 1, "large id", "en", "s0", 8)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def labels(spark):
    data = [(i * 5, i % 2, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (7, None, None), (0, 1, 1)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int").withColumn("fold", F.lit("own"))


PER_ROW = {
    "fingerprints": lambda d, l: fingerprint.fingerprint_edits(d),
    "tokens": lambda d, l: tokens.count_tokens(d, tokenizer_path()),
    "toxicity": lambda d, l: toxicity.score_toxicity(d, l, trees=3),
    "mixing": lambda d, l: mixing.mix_report(d),
    "pii": lambda d, l: pii.surrogate_report(d, KEY),
    "near_duplicates": lambda d, l: neardup.near_duplicates(d),
    "quality": lambda d, l: quality.importance_scores(d, l),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_a_document(docs, labels, rows, name):
    got = PER_ROW[name](docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert PER_ROW[name](docs.limit(0), labels).count() == 0 and PER_ROW[name](docs.limit(0), labels.limit(0)).count() == 0


def test_equal_texts_are_treated_alike(docs, labels, rows):
    by = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for name, column in (("fingerprints", "fingerprint"), ("tokens", "n_tokens"), ("toxicity", "score"), ("pii", "text"), ("near_duplicates", "class_id")):
        seen = {}
        for r in PER_ROW[name](docs, labels).where("doc_id is not null").collect():
            seen.setdefault(by[r.doc_id], set()).add(r[column])
        assert all(len(v) == 1 for v in seen.values()), name


def test_packing_of_odd_rows(docs, rows):
    got = packing.pack(docs, tokenizer_path()).collect()
    t = tokens.load(tokenizer_path())
    want = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(p.length for p in got) == want and {p.doc_id for p in got} == {r[0] for r in rows}
    room = {}
    for p in got:
        room[p.sequence_id] = room.get(p.sequence_id, 0) + p.length
    assert max(room.values()) <= 2048
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


STAGES = {
    "toxicity": lambda d, l: toxicity.without_toxic(d, l, trees=3),
    "near_dedup": lambda d, l: neardup.deduplicated(d),
    "pii": lambda d, l: pii.pseudonymize(d, KEY),
    "mixing": lambda d, l: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(docs, labels, name):
    got = STAGES[name](docs, labels)
    assert got.columns == docs.columns and got.count() > 0
    assert got.where(" or ".join(f"`{c}` <> 'own {c}'" for c in EXTRA)).count() == 0
    assert STAGES[name](docs.limit(0), labels).count() == 0


def test_top_k_and_urls_with_odd_columns(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (None, [1.0, 1.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    v = v.withColumn("x", F.lit("own")).withColumn("dim", F.lit("own")).withColumn("a.b", F.lit(1))
    got = {(r.query_id, r["rank"]): r.vec_id for r in topk.top_k(v).collect()}
    assert got == {(0, 1): 50, (0, 2): 1, (0, 3): 2, (50, 1): 0, (50, 2): 1, (50, 3): 2} and topk.top_k(v.limit(0)).count() == 0
    urls = ["http://1.2.3.4/x", "https://[2001:db8::1]:80/", "http://shop.co.uk/", "http://a.shop.co.uk", "ftp://x/" + "y" * 100_000, "", None, "http://a.shop.co.uk"]
    caps = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched", F.lit("2024-05-01").cast("date")).withColumn("host", F.lit("own"))
    ents = spark.createDataFrame([("3.4",), ("co.uk",), ("shop.co.uk",), ("[2001:db8::1]",)], "domain string").withColumn("day", F.lit("2024-01-01").cast("date")).withColumn("action", F.lit("block"))
    got = {r.page_id: r.matched for r in urlfilter.temporal_filter(caps, ents).collect()}
    assert got == {0: None, 1: "[2001:db8::1]", 2: "shop.co.uk", 3: "shop.co.uk", 4: None, 5: None, 6: None, 7: "shop.co.uk"}
    assert urlfilter.temporal_filter(caps.limit(0), ents).count() == 0 and urlfilter.temporal_filter(caps, ents.limit(0)).where("blocked").count() == 0


def test_the_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(WORDS, k=60)
        if i % 6 == 0:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(["blorgish", "blorgful"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(60):  # near copies of clean texts, with personal data in some
        w = rows[6 * i + 1][1].split()
        w[3] = "other"
        rows.append((1000 + i, " ".join([*w, f"u{i}@mail.org"]), "en", f"s{i % 3}"))
    rows += [(2000, None, "en", "s0"), (2001, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    out, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        out[name] = kept.collect()
    text = lambda name: {r.doc_id: r.text for r in out[name]}
    # toxicity: exactly the documents that score under 0.5
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert sorted(text("toxicity")) == sorted(r.doc_id for r in scored.where("score < 0.5").collect()) and not any("blorg" in (t or "") for t in text("toxicity").values())
    # near duplicates: one document of each class of an exhaustive comparison
    ids = sorted(text("toxicity"))
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((text("toxicity")[i] or "").split() for i in ids)]
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * max(len(shingles[a]), len(shingles[b])):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    assert len(out["near_dedup"]) == len(set(label)) and {label[ids.index(r.doc_id)] for r in out["near_dedup"]} == set(label)
    # surrogates: only documents with entities change
    for i, t in text("pii").items():
        before = text("near_dedup")[i]
        assert (t == before) == ("@" not in (before or ""))
    # mixing: whole copies, three at most
    n = {}
    for r in out["mixing"]:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
        assert r.text == text("pii")[r.doc_id]
    assert max(n.values()) <= 3
    # packing: every id of every copy once
    t = tokens.load(tokenizer_path())
    assert sum(p.length for p in out["packing"]) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in out["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out["packing"])
