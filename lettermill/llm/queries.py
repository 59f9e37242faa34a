"""The corpus operators as named queries over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import bpe, brown, html, packing, pii, quality, secrets, shards, simhash, topk
from lettermill.llm.common import shared_dir, table


def _joined(*spans: str) -> Column:
    """kind:start:end of the spans of the columns, comma-joined, by start, then kind as the columns' operator lists them."""
    return F.array_join(F.transform(spans[0] if len(spans) == 1 else F.concat(*spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(kinds: tuple[str, ...]) -> Column:
    """Base and added spans together, by start, then kind as listed."""
    ranks = F.array(*map(F.lit, kinds))
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(ranks, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _n(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded text."""
    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts and digest of the base spans, and all spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *map(_n, pii.KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _ordered(pii.KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every part of every document, with lengths in words."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", packing.word_count("text").alias("size")), id_col="doc_id").withColumnRenamed("id", "doc_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("id % 20 = 0"), k=20)


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model scores of every document."""
    return brown.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; counts and digest of the base spans, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), *map(_n, secrets.KINDS[:3]), F.sha2(_joined("base"), 256).alias("base_sha256"), _ordered(secrets.KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of every document lie in the shards, which this writes below the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/sequences-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = shards.write_in_order(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, key="training order 1")
    return rows.withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document, with cutoffs learned on the labels."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_brown": op6_brown,
    "op7_html": op7_html,
    "op8_secrets": op8_secrets,
    "op9_shards": op9_shards,
    "op10_quality": op10_quality,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
