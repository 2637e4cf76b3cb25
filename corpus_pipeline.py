"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, packing.

Each stage takes the documents its predecessor kept; all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, packing, simhash
from tessera.llm.shared import Scratch, ship

#: Words of a repeated block of lines that line dedup deletes.
BLOCK_WORDS = 50
#: Words of a shingle and similarity from which documents are near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Id that ends each document in the packed sequences, and their length.
END_ID, WINDOW = 1, 2048
#: Parts in the tokenizer's memo and characters encoded together: small, since the workers of the
#: stages before still hold memory.
MEMO, RUN_CHARS = 250_000, 2 << 20

#: No SQL: it has neither the trigram model nor SimHash nor the tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, ``lang`` set to it; the others go."""
    ship(spark)
    return language.keep_identified(docs, Scratch(spark))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go, and documents with no word left."""
    ship(spark)
    out = line_dedup.line_dedup(docs, Scratch(spark), BLOCK_WORDS)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    ship(spark)
    scratch = Scratch(spark)
    found = simhash.near_duplicates(docs, scratch, SHINGLE_WORDS, SIMILARITY)
    gone = scratch.cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    scratch.release()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of WINDOW ids, with their ids."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, Scratch(spark), WINDOW, with_ids=True, memo=MEMO, run_chars=RUN_CHARS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, between = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = between.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
