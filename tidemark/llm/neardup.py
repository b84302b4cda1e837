"""Near duplicates by Order MinHash on five-word shingles, verified by banded alignment (operator 9).

A text's shingles are its runs of five words (white space apart, lower case), each labelled with
its occurrence number, so repeats count. Two texts are linked if their edit similarity is 0.8 or
more: the shingles that an alignment matches in order, over the shingles of the longer text. Every
pair of Jaccard similarity 0.8 with its text in order is linked (it has 0.89 by this measure);
texts that only share passages are not.

One Order MinHash value takes the ``TUPLE`` least labelled shingles under one hash function and
combines them in text order; two texts of Jaccard similarity s agree on a value with probability
about s ** TUPLE, if the order agrees. An edit similarity of 0.8 is a Jaccard similarity of 2/3
between texts of equal length: of such pairs, the least similar that count, ``BANDS`` values of
``TUPLE`` miss one in a hundred, of pairs of Jaccard 0.8 fewer than one in a hundred thousand.

Texts of few shingles share too few tuples for that. Pairs whose smaller text has at most ``SHORT``
shingles get an exact path instead: each text's shingles are sorted by how many short texts have
them, rarest first, and texts meet on each shingle of their prefix. Two texts of n and m shingles
that reach ``least`` share ceil(least * n) of them or more, so the first n - ceil(least * n) + 1
of each hold a common one: no such pair is missed.

The alignment is the longest common subsequence of labelled shingles inside a diagonal band.
Labelled shingles are distinct 64-bit hashes, so that is a longest increasing subsequence of
matched positions; an aligned shingle of such a pair is displaced by at most a fifth of the longer
text, so the band loses none of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, with_text
from tidemark.llm.components import components

WORDS, LEAST = 5, 0.8
BANDS, TUPLE = 32, 5
#: Pairs whose smaller text has at most so many shingles are found without loss.
SHORT = 32
#: Members of a bucket that are compared in one group; larger buckets are cut into blocks.
BLOCK = 128
_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD1B54A32D192ED03 * (k + 7))) & (2**64 - 1) | 1 for k in range(BANDS)], np.uint64)


class Shingler:
    """Labelled shingle hashes of texts, in text order; word hashes are kept in a bounded memo."""

    def __init__(self, words: int = WORDS, size: int = 100_000):
        self.words, self.size, self.memo = words, size, {}

    def __call__(self, text: str) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.size:
            memo.clear()
        tokens = text.lower().split()
        for t in set(tokens).difference(memo):
            memo[t] = xxhash.xxh3_64_intdigest(t)
        w = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(w))
        if not k:
            return w
        n = len(w) - k + 1
        h = w[:n].copy()
        for i in range(1, k):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : i + n]
        h = _mix(h)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            start = np.concatenate([[True], ~same])
            at = np.arange(n)
            count = np.empty(n, np.uint64)
            count[order] = at - np.maximum.accumulate(np.where(start, at, 0))
            h = np.where(count > 0, _mix(h + count * np.uint64(0x9E3779B97F4A7C15)), h)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def order_minhash(h: np.ndarray, tuple_size: int = TUPLE) -> np.ndarray:
    """One value a band: the least ``tuple_size`` labelled shingles, combined in text order."""
    n = len(h)
    k = min(tuple_size, n)
    out = np.empty(BANDS, np.uint64)
    step = max(1, 2_000_000 // n)
    for a in range(0, BANDS, step):
        g = h[None, :] * _MULT[a : a + step, None]
        g ^= g >> np.uint64(32)
        at = np.argpartition(g, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), g.shape)
        picked = h[np.sort(at, axis=1)]
        v = np.full(len(g), np.uint64(k), np.uint64)
        for i in range(k):
            v = _mix(v * np.uint64(0x100000001B3) + picked[:, i])
        out[a : a + step] = v
    return out.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Shingles matched in order over those of the longer text, by a banded longest common subsequence.

    Pairs that cannot reach ``least`` may get another value below it; 1.0 for two empty texts.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    if min(len(a), len(b)) < least * longer:
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) < least * longer:
        return len(i) / longer
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= int((1 - least) * longer) + 1]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j) / longer
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails) / longer


def shared_counts(texts: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many shingles each two of ``texts`` have in common: products of membership matrices, ``columns`` shingles at a time."""
    n = len(texts)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    _, at, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    keep = count[at] > 1  # a shingle of one text alone is shared by none
    owner, at = owner[keep], np.unique(at[keep], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        lo, hi = np.searchsorted(at, (a, a + columns))
        member = np.zeros((n, columns), np.float32)
        member[owner[lo:hi], at[lo:hi] - a] = 1
        out += member @ member.T
    return out


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def sketches(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, digest (md5 of the text), sketch (null for at most ``SHORT`` shingles), short: one pass, no shuffle.

    ``short`` holds all shingles of a text that can be similar to one of at most ``SHORT``; texts of
    more than ``SHORT`` that still can have both.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for pdf in batches:
            seen: dict[str, list[int] | None] = {}
            short: dict[str, list[int] | None] = {}
            for d, t in zip(pdf["digest"], pdf["text"], strict=True):
                if d not in seen:
                    h = shingle(t)
                    seen[d] = order_minhash(h).tolist() if len(h) > SHORT else None
                    short[d] = h.view(np.int64).tolist() if 0 < len(h) and len(h) * least <= SHORT + 1e-9 else None
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "sketch": pdf["digest"].map(seen.get), "short": pdf["digest"].map(short.get)})

    src = with_text(docs).withColumn("digest", F.md5("text")).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = src.mapInPandas(run, "doc_id string, digest string, sketch array<long>, short array<long>")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def _prefixes(texts: DataFrame, least: float) -> DataFrame:
    """tid, band (``BANDS``), value: the shingles of each short text's prefix, rarest first, that other short texts have."""
    each = texts.where("short is not null").select("tid", F.size("short").alias("n"), F.explode("short").alias("value"))
    held = each.groupBy("value").agg(F.count("*").alias("k")).where("k > 1")
    got = each.join(held.hint("merge"), "value").groupBy("tid", "n").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("common"))
    # shingles that no other text has come first in the prefix and join nothing
    left = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - (F.col("n") - F.size("common"))
    got = got.withColumn("left", left.cast("int")).where("left > 0")
    got = got.select("tid", F.explode(F.slice("common", F.lit(1), F.col("left"))).alias("c"))
    return got.select("tid", F.lit(BANDS).alias("band"), F.col("c.value").alias("value"))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """tid, shingles (64-bit labelled hashes in text order) of (tid, text) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for pdf in batches:
            yield pd.DataFrame({"tid": pdf["tid"], "shingles": [_pack(shingle(t)) for t in pdf["text"].tolist()]})

    return texts.mapInPandas(run, "tid long, shingles binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row a document: doc_id, digest, tid (its distinct text), class_id, is_kept.

    Classes are the connected components of the links between distinct texts, so class_id loses no
    link; it is the least tid in it, and one document of each class (the least doc_id of that text)
    is kept. Null and empty texts are one class. Repeated rows share doc_id and digest; equal texts
    tie for is_kept, and the least doc_id (a null one last) has it. tid is the least doc_id that has
    the text; where that is null, negative or shared by different texts, it is a negative 63-bit
    hash of the text. An empty table gives no rows; other columns, whatever their names, play no
    part. A very long text is one row of 8 bytes a word in one task.

    1. One pass makes a digest and a sketch, or the shingles of a short text; exact copies collapse
       by digest (combined before the shuffle), so a hot text is one row from here on.
    2. Every member of a bucket is verified against the bucket's least text; components follow.
    3. Buckets that still hold several components compare all members of different components, in
       blocks of about ``BLOCK`` whose shared shingles are counted by matrix products; only pairs
       that share enough are aligned. Buckets with the same members count once. The work of a task
       is bounded, and pairs stay inside it. So no pair that shares a bucket is left out, and no
       list of all pairs is made.
    """
    rows = materialize(sketches(docs, words, least), "op9-sketches", waves=16)
    grouped = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("short").alias("short"))
    grouped = materialize(grouped, "op9-texts")
    # tid: doc_id, unless different texts share it
    shared = grouped.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id < 0").select("doc_id")
    own_hash = -F.shiftrightunsigned(F.xxhash64("digest"), 1) - 1
    if shared.limit(1).count():
        bad = shared.withColumnRenamed("doc_id", "bad_id")
        texts = grouped.join(bad.hint("merge"), grouped["doc_id"].eqNullSafe(bad["bad_id"]), "left").withColumn(
            "tid", F.when(F.col("doc_id").isNull() | F.col("bad_id").isNotNull(), own_hash).otherwise(F.col("doc_id"))
        )
    else:
        texts = grouped.withColumn("tid", F.coalesce("doc_id", own_hash))
    texts = texts.select("digest", "tid", "sketch", "short")

    bands = texts.select("tid", F.posexplode("sketch").alias("band", "value")).unionByName(_prefixes(texts, least))
    firsts = bands.groupBy("band", "value").agg(F.min("tid").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = materialize(bands.join(firsts.hint("merge"), ["band", "value"]).select("band", "value", "tid", "rep", "n"), "op9-members")
    star = members.where("tid <> rep").select("tid", "rep").distinct()

    involved = members.select("tid").distinct().join(texts.select("digest", "tid").hint("merge"), "tid")
    involved = materialize(involved, "op9-involved")
    src = rows.select("doc_id", "digest").join(F.broadcast(involved) if involved.count() <= 200_000 else involved.hint("merge"), "digest")
    one_row = materialize(src.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.first("digest").alias("digest")), "op9-pick")
    picked = F.broadcast(one_row) if one_row.count() <= 200_000 else one_row.hint("merge")
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.md5("text") == F.col("digest"))
    text = with_text(docs).alias("d").join(picked.alias("p"), on).select("tid", "text")
    shingles = materialize(_shingles(text, words).dropDuplicates(["tid"]), "op9-shingles")

    label = components(_verify_pairs(star, shingles, least))

    known = members.where("n > 2").join(label.withColumnRenamed("node", "tid").hint("merge"), "tid", "left").select(
        "band", "value", "tid", "n", F.coalesce("label", "tid").alias("label")
    )
    known = materialize(known, "op9-labelled")
    # several components, and the first of the buckets that have the same members (by two 64-bit sums of hashes)
    same = [F.sum(F.xxhash64("tid") % 2**32).alias("s"), F.sum(F.xxhash64(F.lit(1), "tid") % 2**32).alias("t")]
    mixed = known.groupBy("band", "value").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.first("n").alias("n"), *same).where("a <> b")
    mixed = mixed.groupBy("s", "t", "n").agg(F.min(F.struct("band", "value")).alias("m")).select("m.band", "m.value")
    rest = known.join(mixed.hint("merge"), ["band", "value"], "left_semi")
    more = materialize(_verify_blocks(rest, shingles, least), "op9-more", waves=2)
    if more.limit(1).count():  # links between components: their labels are joined in turn
        upper = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
        label = label.join(upper.hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        lone = upper.select(F.col("label").alias("node"), F.col("top").alias("label"))
        label = label.unionByName(lone).groupBy("node").agg(F.min("label").alias("label"))
    classes = texts.select("digest", "tid").join(label.withColumnRenamed("node", "tid").hint("merge"), "tid", "left")
    classes = classes.select("digest", "tid", F.coalesce("label", "tid").alias("class_id"))
    heads = grouped.select("digest", F.col("doc_id").alias("first_doc"))
    classes = materialize(classes.join(heads.hint("merge"), "digest"), "op9-classes")
    out = rows.select("doc_id", "digest").join(classes.hint("merge"), "digest")
    kept = (F.col("tid") == F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))
    return out.select("doc_id", "digest", "tid", "class_id", kept.alias("is_kept"))


def _verify_pairs(star: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """u, v of the (tid, rep) pairs that are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [
                aligned_similarity(_unpack(a), _unpack(b), least) >= least
                for a, b in zip(pdf["sa"], pdf["sb"], strict=True)
            ]
            yield pdf.loc[keep, ["u", "v"]]

    a = shingles.select(F.col("tid"), F.col("shingles").alias("sa"))
    b = shingles.select(F.col("tid").alias("rep"), F.col("shingles").alias("sb"))
    pairs = star.join(a.hint("merge"), "tid").join(b.hint("merge"), "rep")
    return pairs.select(F.col("rep").alias("u"), F.col("tid").alias("v"), "sa", "sb").mapInPandas(run, "u long, v long")


def _verify_blocks(rest: DataFrame, shingles: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """u, v: labels of different components that hold similar members of a bucket, block against block."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("tid", "band"), blocks).cast("int")).join(shingles.hint("merge"), "tid")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "band", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "tid", "label", "shingles"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        out = []
        if pdf["label"].nunique() > 1:
            pdf = pdf.sort_values("tid")
            one = pdf["x"].iloc[0] == pdf["y"].iloc[0]
            own, label = pdf["own"].to_numpy(), pdf["label"].to_numpy()
            texts = list(map(_unpack, pdf["shingles"]))
            n = np.array(list(map(len, texts)))
            enough = shared_counts(texts) >= least * np.maximum(n[:, None], n[None, :]) - 1e-6
            enough &= label[:, None] != label[None, :]
            if not one:  # pairs inside a block are met elsewhere
                enough &= own[:, None] != own[None, :]
            for i, j in np.argwhere(np.triu(enough, 1)).tolist():
                a, b = find(int(label[i])), find(int(label[j]))
                if a != b and aligned_similarity(texts[i], texts[j], least) >= least:
                    top[max(a, b)] = min(a, b)
                    out.append((int(label[i]), int(label[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rest.groupBy("band", "value", "x", "y").applyInPandas(run, "u long, v long")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, one of each class; columns as given, whatever their names.

    Nulls, empty texts, ties, repeated rows (one of them stays) and very long texts as in
    :func:`near_duplicates`; an empty table stays empty.
    """
    keep = near_duplicates(docs, **options).where("is_kept").groupBy("doc_id", "digest").agg(F.count("*").alias("rows"))
    keep = materialize(keep.select(*[F.col(c).alias(f"k_{c}") for c in ("doc_id", "digest", "rows")]), "op9-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col("doc_id").alias("own_id"), F.md5(F.coalesce("text", F.lit(""))).alias("own_digest"))
    out = d.join(keep.hint("merge"), F.col("own_id").eqNullSafe(F.col("k_doc_id")) & (F.col("own_digest") == F.col("k_digest")))
    if keep.where("k_rows > 1").limit(1).count():  # repeated rows: one of them stays
        out = out.dropDuplicates(["k_doc_id", "k_digest"])
    return out.select("row.*")
