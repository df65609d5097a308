"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm import alignment, audit, avi, lines, minhash, packing, pieces, pitman_yor, quality, secrets, simhash, sql, training_order, warc
from scanframe.llm.common import shared_dir, table


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.groups(docs).select("doc_id", "fingerprint", "component_id")


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.without_copies(table(spark, sf_dir, "documents"))
    gone = F.coalesce(F.size("deleted"), F.lit(0))
    return docs.select("own.doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.when(gone > 0, gone).otherwise(0).cast("bigint").alias("n_deleted"),
                       F.coalesce(F.array_join("deleted", ","), F.lit("")).alias("deleted_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    per_kind = [secrets.count_of(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    return found.select("doc_id", *per_kind, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    training_order.write(table(spark, sf_dir, "documents"), uri, tokenizer("word_bpe_49k.json"))
    return training_order.pieces(spark, uri)


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), uri)
    return warc.read(spark, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return avi.digests(avi.to_avi(docs))


def op8_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, tokenizer("piece_bpe_32k.model"))


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_run_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_gray_simhash, op2_line_runs, op3_markov_secrets, op4_feistel_shards, op5_cost_packing, op6_warc_shards, op7_avi_clips, op8_distinct_chunks, op9_adaptive_quality,
                           op10_pitman_yor, op11_minhash_bands, op12_path_counts, op13_run_skipping)}
ORACLES: dict[str, str] = {
    "op2_line_runs": sql.line_runs(lines.MIN_WORDS),
    "op6_warc_shards": sql.warc(),
    "op9_adaptive_quality": sql.quality(quality.FENCES, quality.MIN_WORDS, quality.MAX_REPEAT_PERCENT, quality.MIN_GROUP),
    "op12_path_counts": sql.interactions(),
}
