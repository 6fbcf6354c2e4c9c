"""A corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of ``documents``; the last adds token ids with their byte spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chosen_path, decontaminate, piece_codec, quality, substring_dedup
from gridloom.llm.common import materialize, table
from gridloom.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays, that of the smallest doc_id."""
    return chosen_path.one_per_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus are cut out of the texts."""
    return substring_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the span of original bytes of each."""
    coded = piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source", "n_chars"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeated_strings", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("token_ids", encode),
]

# A fitted classifier, a sketch search and cutting bytes have no SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
