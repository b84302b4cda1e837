"""Queries over the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import conversations, fingerprint, hosts, mixing, neardup, negatives, packing, pii, quality, tokens, topk, toxicity, urlfilter


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


#: The key of the registered query and the pipeline over made-up documents; real corpora need a secret one.
EXAMPLE_KEY = "example key, not a secret"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_report(_read(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "tid", "class_id", "is_kept")


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.temporal_filter(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(_read(spark, sf_dir, "conversations")), _read(spark, sf_dir, "conversations"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(_read(spark, sf_dir, "embeddings")))


def op13_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.host_rules(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_fingerprints, op2_token_counts, op3_quality, op4_topk, op5_toxicity, op6_mixing, op7_pii, op8_packing, op9_neardup, op10_urlfilter,
        op11_conversations, op12_negatives, op13_hosts,
    )
    return {f.__name__: f for f in own}


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, row_number() OVER () AS row FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
i AS (SELECT vec_id, row, list_transform(x, lambda e: floor(256 * e)) AS x, len(x) AS dim FROM v),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM i q JOIN i c ON c.dim = q.dim AND c.row <> q.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op10_urlfilter": urlfilter.SQL, "op11_conversations": conversations.SQL, "op12_negatives": negatives.SQL, "op13_hosts": hosts.SQL}
