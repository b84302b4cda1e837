"""Mixing sources to target weights by pivotal dependent rounding (operator 6)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize

#: Rows that are rounded together, about; also the fan-in of the reduction tree.
BUCKET_ROWS = 256


def _uniform(seed: int, *parts) -> float:
    d = hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest()
    return int.from_bytes(d, "big") / 2**64


def pivotal(items: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """Pair fractional probabilities and move mass until one of each pair is 0 or 1.

    ``items``: (key, weight, p) with 0 < p < 1, heaviest first. The heaviest open item is paired with
    the next one, or, where that has under half its weight, with as many of the next ones as have room for
    its words: it becomes 0 or 1 with odds p, and they take its words, or give those it lacks, each as
    much as it can do both ways (if all have too little room, the next one alone is its partner). So
    weights keep their sum, each p its expectation, and what stays open is light. Returns the decided
    (key, 0 or 1) and what is left: one (key, weight, p), or None.
    """
    keys = [k for k, _, _ in items]
    w, p = (np.array([x[i] for x in items], float) for i in (1, 2))
    done, left = [], np.arange(len(items))
    while len(left) > 1:
        one, rest = left[0], left[1:]
        down, up = p[one] * w[one], (1 - p[one]) * w[one]  # words that leave the item, or come to it
        u = _uniform(seed, keys[one], keys[rest[0]])
        share = np.minimum((1 - p[rest]) / down, p[rest] / up)
        room = np.cumsum(share * w[rest])
        if room[-1] >= 1 and 2 * w[rest[0]] < w[one]:
            k = int(np.searchsorted(room, 1.0))
            share[k] *= 1 - (room[k] - 1) / (share[k] * w[rest[k]])
            joins = u < p[one]
            p[rest[: k + 1]] += share[: k + 1] * (-up if joins else down)
            p[one] = float(joins)
        else:
            two = rest[0]
            to_one, to_two = min(up, p[two] * w[two]), min(down, (1 - p[two]) * w[two])
            moved = to_one if u * (to_one + to_two) < to_two else -to_two
            p[one], p[two] = p[one] + moved / w[one], p[two] - moved / w[two]
        shut = (p[left] <= 1e-12) | (p[left] >= 1 - 1e-12)
        done += [(keys[i], int(p[i] > 0.5)) for i in left[shut]]
        left = left[~shut]
    return done, ((keys[left[0]], float(w[left[0]]), float(p[left[0]])) if len(left) else None)


def words_of(text: str) -> F.Column:
    """The size of a text column: its words (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Sources in code-point order (null last) weigh ``weights``, repeating. They share all words by
    weight; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight until none is above. That is target = min(level * weight, cap * size) for one level,
    found in one pass over the sources in the order of cap * size / weight. The windows run over
    one row a source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units")).withColumn("one", F.lit(1))
    order = Window.partitionBy("one").orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by = Window.partitionBy("one").orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.partitionBy("one")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level if this source and all later ones stay open
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("l")))).over(every)
    target = F.when(first.isNull(), F.col("limit")).otherwise(F.least(first["l"] * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", "units", target.alias("target"))


def _balanced(rated: DataFrame, small: bool) -> DataFrame:
    """Documents heavier than all the words that chance moves in their source are rounded at once.

    Nothing could balance such a draw. They take their nearest number of copies, and the others' p is what
    meets the target then; where the others are too few for that, all keep their p.
    """
    weight = F.col("size") * F.col("n_rows")
    heavy = (F.col("p") > 1e-12) & (weight > F.least(F.col("p"), 1 - F.col("p")) * F.col("source_size"))
    per = rated.groupBy("source").agg(
        F.sum(F.when(heavy, 0).otherwise(weight)).alias("light"), F.sum(F.when(heavy & (F.col("p") >= 0.5), weight).otherwise(0)).alias("fixed")
    )
    per = per.select(F.col("source").alias("b_source"), "light", "fixed")
    d = rated.join(F.broadcast(per) if small else per.hint("merge"), F.col("source").eqNullSafe(F.col("b_source")))
    other = (F.col("p") * F.col("source_size") - F.col("fixed")) / F.nullif("light", F.lit(0))
    fits = F.coalesce((other >= 0) & (other < 1) & (F.col("p") > 1e-12), F.lit(False))
    whole = F.col("whole") + F.when(fits & heavy & (F.col("p") >= 0.5), 1).otherwise(0)
    return d.select(*[c for c in rated.columns if c not in ("whole", "p")], whole.alias("whole"), F.when(~fits, F.col("p")).when(heavy, 0.0).otherwise(other).alias("p"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    seed: int = 20,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns one row for each distinct (doc_id, source, size): n_rows (repeated rows are decided
    together), source_size, target, copies (0 to ceil(cap)). Sizes are words; a null text has
    size 0, is never copied, and a null source is a source of its own. Runs agree: the dealing and
    the draws depend on doc_id, source, size and ``seed`` only.

    Each source's rate r = target / size gives every document floor(r) copies and a fractional one
    with probability r - floor(r). Buckets of a source (dealt by hash, so a hot source spans many)
    round theirs by :func:`pivotal`; each leaves at most one fractional document, and these meet in
    a tree of the same fan-in until each source has one left, which a last draw decides. So a
    source's words miss its target by at most one document, a light one where the others have room
    for the heavy ones.
    """
    units = materialize(
        docs.select("doc_id", "source", words_of("text").alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n_rows")),
        "op6-units",
    )
    weighted = units.withColumn("size", F.col("size") * F.col("n_rows"))
    targets = materialize(source_targets(weighted, weights, cap), "op6-targets")
    null_safe = F.col("u.source").eqNullSafe(F.col("t.source"))
    # one row a source: the write above checks that it is small enough to send to every task
    small = targets.count() <= 100_000
    rated = (
        units.alias("u")
        .join((F.broadcast(targets) if small else targets.hint("merge")).alias("t"), null_safe)
        .select("u.*", "t.source_size", "t.target", "t.units")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("int"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    )
    rated = materialize(_balanced(rated, small), "op6-rates")
    buckets = F.ceil(F.col("units") / bucket_rows)
    level = rated.where("p > 1e-12 and size > 0").select(
        F.col("doc_id").cast("string").alias("doc"),  # a string: pandas would turn a nullable long into a double
        "source",
        "size",
        (F.col("size") * F.col("n_rows")).cast("double").alias("w"),
        "p",
        F.pmod(F.xxhash64("doc_id", "size"), buckets).alias("bucket"),
    )
    most = targets.agg(F.max(buckets)).first()[0] or 1
    schema = "doc string, source string, size long, w double, p double, bucket long, copy int"
    names = [c.split()[0] for c in schema.split(", ")]

    def rounds(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # heavy documents first, so what stays open is light
            pdf = pdf.sort_values(["w", "size", "doc"], ascending=[False, False, True], na_position="last").reset_index(drop=True)
            rows = zip(pdf["doc"], pdf["size"], pdf["w"], pdf["p"], strict=True)
            done, held = pivotal([((d, int(s)), w, p) for d, s, w, p in rows], seed)
            copy = dict(done)
            if held and last:
                copy[held[0]] = int(_uniform(seed, "last", held[0]) < held[2])
                held = None
            keys = list(zip(pdf["doc"], (int(x) for x in pdf["size"]), strict=True))
            pdf["copy"] = pd.array([copy.get(k) for k in keys], dtype="Int32")
            if held:
                pdf.loc[keys.index(held[0]), "p"] = held[2]
            return pdf[names]

        return run

    decided = []
    while True:
        last = most == 1
        level = materialize(level.groupBy("source", "bucket").applyInPandas(rounds(last), schema), "op6-level")
        decided.append(level.where("copy is not null").select("doc", "source", "size", "copy"))
        if last:
            break
        level = level.where("copy is null").withColumn("bucket", F.expr(f"bucket div {bucket_rows}")).drop("copy")
        most = -(-most // bucket_rows)
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.unionByName(d)
    extra = extra.select(*[F.col(c).alias(f"x_{c}") for c in ("doc", "source", "size")], "copy")
    rated = rated.withColumn("doc", F.col("doc_id").cast("string"))
    same = [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in ("doc", "source", "size")]
    return (
        rated.join(extra.hint("merge"), same, "left")
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(0))
        .select("doc_id", "source", "size", "n_rows", "source_size", "target", "copies")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (copies times size)."""
    m = mix(docs, **options)
    return m.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("row_no"),
    ).drop("row_no")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it; columns as given, whatever their names.

    Null sources are a source of their own; null and empty texts have no words and are never taken;
    repeated rows are decided together; an empty table stays empty. A very long text is one unit.
    """
    m = mix(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("m_doc_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("copies").alias("m_copies")
    )
    m = materialize(m, "op6-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), words_of("text").alias("own_size"))
    on = F.col("own_id").eqNullSafe(F.col("m_doc_id")) & F.col("own_source").eqNullSafe(F.col("m_source")) & (F.col("own_size") == F.col("m_size"))
    copies = d.join(m.hint("merge"), on).select("row", F.explode(F.sequence(F.lit(1), F.col("m_copies"))).alias("copy"))
    return copies.select("row.*")
