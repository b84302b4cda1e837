"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 5)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold, materialize, with_text
from tidemark.llm.dense import PREFIXES, Features

#: Labelled rows of one fold that a fit reads at most, by hash order of doc_id.
FIT_ROWS = 12_000


def featurize(rows: DataFrame, lexicons: dict[int, dict[str, float]], text: str = "text", fold: Column | None = None) -> DataFrame:
    """``rows`` and a column ``features`` of the column ``text`` (null: empty); no shuffle.

    ``fold`` names the lexicon of a row (none given: lexicon 0). Only text and fold travel to Python
    and 16 doubles come back; the other columns stay in the JVM.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        by_fold = {k: Features(x) for k, x in lexicons.items()}
        for texts, folds in batches:
            yield pa.array([by_fold[k](t.as_py() or "") for t, k in zip(texts, folds.to_pylist(), strict=True)], pa.list_(pa.float64()))

    # not deterministic to the optimizer, so a filter on the score never runs it a second time
    which = F.lit(0) if fold is None else fold.cast("int")
    return rows.withColumn("features", run.asNondeterministic()(F.col(text), which))


def learn_lexicons(rows: DataFrame, least_docs: int = 4, size: int = 400) -> dict[int, dict[str, float]]:
    """Terms that mark toxic texts: word or prefix -> log odds, from (text, label, fold) rows.

    Lexicon f (1 to 4) is learned from the rows outside fold f, lexicon 0 from all. A term counts
    once a text. One aggregation over all given rows counts terms by fold; at most ``size`` terms a
    lexicon come to the driver.
    """
    low = F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[\W_]+|[\W_]+$", ""))
    words = rows.select("label", "fold", F.explode(F.array_distinct(low)).alias("w")).where("length(w) > 1")
    kinds = [F.col("w")] + [F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("~"))) for k in PREFIXES]
    terms = words.select("label", "fold", F.explode(F.array(*kinds)).alias("term")).where("term is not null")
    of = {f: F.col("fold") != f for f in range(5)}  # no row is of fold 0
    sums = [x for f, c in of.items() for x in (F.sum(F.when(c, F.col("label")).otherwise(0)).alias(f"a{f}"), F.count_if(c).alias(f"b{f}"))]
    total = rows.agg(*sums).first()
    counts = materialize(terms.groupBy("term").agg(*sums).where("a0 >= " + str(least_docs)), "op5-terms", waves=1)
    out: dict[int, dict[str, float]] = {}
    for f in of:
        n1, n = total[f"a{f}"] or 0, total[f"b{f}"]
        if not 0 < n1 < n:
            out[f] = {}
            continue
        a, b = F.col(f"a{f}"), F.col(f"b{f}")
        odds = F.log(((a + 0.1) / (n1 + 1)) / ((b - a + 0.5) / (n - n1 + 1)))
        top = counts.where(a >= least_docs).select("term", a.alias("a"), odds.alias("odds")).where("odds > 2")
        out[f] = {r.term: float(r.odds) for r in top.orderBy(F.desc(F.col("odds") * F.sqrt("a")), "term").limit(size).collect()}
    return out


class ToxicityModel:
    """Fitted lexicon, trees and calibration; ``rate`` is the base rate if there was nothing to learn."""

    def __init__(self, lexicon=None, trees=None, isotonic=None, rate: float = 0.0):
        self.lexicon, self.trees, self.isotonic, self.rate = lexicon or {}, trees, isotonic, rate

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` and score: calibrated, with a thousandth of the raw score to break ties."""
        keep = rows.columns
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.rate))
        df = featurize(rows, {0: self.lexicon}, text)
        df = self.trees.transform(df.withColumn("vector", array_to_vector("features")))
        df = df.withColumn("raw", vector_to_array("probability")[1])
        if self.isotonic is not None:
            df = self.isotonic.transform(df).withColumn("score", F.least(F.lit(1.0), F.col("calibrated") * 0.999 + F.col("raw") * 0.001))
        else:
            df = df.withColumn("score", F.col("raw"))
        return df.select(*keep, "score")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 20, depth: int = 3) -> ToxicityModel:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0, by cross-fitting.

    Each fold's features come from a lexicon of the other folds. Trees of two folds score the other
    two, both ways, and the calibration learns from those scores; the trees that stay are grown on all
    folds. So every step sees texts that the step before did not learn from, and every label serves
    each step. A fold reads at most ``fit_rows`` rows, the first in hash order of doc_id; that bound also
    makes the labels small enough to broadcast. A doc_id with several labels counts as toxic if any
    says so; null labels and ids are left out.
    """
    own = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
        .withColumn("fold", crc_fold(F.col("doc_id")))
        .where("fold <> 0")
        .withColumn("ord", F.xxhash64("doc_id"))
    )
    parts = [own.where(F.col("fold") == f).orderBy("ord", "doc_id").limit(fit_rows) for f in range(1, 5)]
    some = materialize(functools.reduce(DataFrame.union, parts).select("doc_id", "label", "fold"), "op5-labels")
    rows = materialize(with_text(docs).join(F.broadcast(some), "doc_id").select("text", "label", "fold"), "op5-sample", waves=16)
    seen = {r.half: (r.n, r.pos) for r in rows.groupBy((F.col("fold") <= 2).alias("half")).agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}
    n, pos = sum(a for a, _ in seen.values()), sum(b for _, b in seen.values())
    if not 0 < pos < n:
        return ToxicityModel(rate=pos / n if n else 0.0)
    lexicons = learn_lexicons(rows)
    # features on all cores, then a few kilobytes a hundred rows in two partitions for the many small jobs of the trees
    vectors = featurize(rows, lexicons, fold=F.col("fold")).select(F.col("label").cast("double").alias("label"), "fold", "features").repartition(2)
    vectors = materialize(vectors, "op5-features").withColumn("vector", array_to_vector("features"))
    gbt = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7)
    isotonic = None
    if all(0 < b < a for a, b in (seen.get(True, (0, 0)), seen.get(False, (0, 0)))):
        halves = [vectors.where("fold <= 2"), vectors.where("fold > 2")]
        raw = [gbt.fit(x).transform(y).select(vector_to_array("probability")[1].alias("raw"), "label") for x, y in (halves, halves[::-1])]
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(materialize(raw[0].union(raw[1]), "op5-raw", waves=1))
    return ToxicityModel(lexicons[0], gbt.fit(vectors), isotonic, pos / n)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts score as a text without words; equal texts score equally, whatever their
    ids; repeated rows give a row each; an empty table gives none. A null doc_id counts as held out
    (crc32 of the empty string). Texts are read in slices, so a very long one needs no more memory
    than itself. Other columns, whatever their names, play no part.
    """
    out = fit(docs, labels, **options).score(with_text(docs))
    return out.select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that score under 0.5; columns as given, whatever their names.

    Nulls, empty and very long texts, ties and repeated rows as in :func:`score_toxicity`.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return fit(docs, labels, **options).score(rows, "row.text").where("score < 0.5").select("row.*")
