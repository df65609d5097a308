"""A training corpus from raw documents: five operators of ``scanframe.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the shared folder and
reads it back as the next one's ``docs``; a stage's table goes once the next is written. All stages but the last return
the columns of ``documents``, and any others there are, whatever their names.

Defined results: a null text has no words, so quality rules reject it; null languages and sources are groups of their
own. Documents that line dedup empties stay, empty; near dedup then keeps one of them. Rows that repeat an id and a text
are judged and cut alike, and near dedup keeps one of them. Of a group of near duplicates the least id stays, of equal
ids the least text hash, a null id only where there is no other. Texts are processed whole at any length. An empty table
goes through every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanframe.llm import lines, packing, quality, secrets, simhash
from scanframe.llm.common import Scratch
from scanframe.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("secret scan", secret_scan), ("packing", pack)]
#: SQL can't express near-dedup and packing; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        kept = tables.store(stage(spark, docs, sf_dir))
        if i:
            tables.drop(docs)
        docs = kept
    return docs
