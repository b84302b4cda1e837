"""A corpus pipeline: five of the operators, each stage written as Parquet and read again.

Counted as part of ``tidemark.llm``. Each stage takes (spark, docs, sf_dir) and works on all that
its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, packing, pii, toxicity
from tidemark.llm.common import discard, materialize, small_batches
from tidemark.llm.queries import EXAMPLE_KEY, tokenizer_path


#: Rows of an Arrow batch: whole texts are in a Python worker by the batch.
BATCH_ROWS = 1000


def stage(f):
    """A stage function; stages return lazily, so the batch size is set for the session (:func:`run` sets it back)."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return f(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go.

    Null and empty texts score as texts without words; equal texts meet the same fate; repeated rows
    stay repeated; an empty table stays empty; all columns come back, whatever their names.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays.

    Null and empty texts are one class; among equal texts the least doc_id stays (a null one last), of
    repeated rows one; an empty table stays empty; columns come back as given.
    """
    return neardup.deduplicated(docs)


@stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the new text.

    Null texts stay null; equal entities get equal surrogates in all rows; no row is lost or added; an
    empty table stays empty; other columns come back as given.
    """
    out = pii.pseudonymize(docs, EXAMPLE_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document is left out, or repeated up to three times.

    Texts without words are never taken; a null source is one of its own; repeated rows are decided
    together; an empty table stays empty; columns come back as given.
    """
    return mixing.mixed_documents(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of at most 2048 tokens.

    Null and empty texts pack their end id; copies of a document are packed each; a long text is cut
    into full sequences and one remainder; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't train trees, sample permutations or run the tokenizer; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted when the next one is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES:
        with small_batches(spark, BATCH_ROWS):
            docs = materialize(apply(spark, docs, sf_dir), f"pipeline-{name}", waves=16)
        if written is not None:
            discard(written)
        written = docs
    return docs
