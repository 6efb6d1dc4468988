"""A corpus pipeline of five stages: toxic documents go, near duplicates go, benchmark passages and secrets are cut out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import decontaminate
from weftline.llm.ngram_join import ngram_join
from weftline.llm.packing import pack
from weftline.llm.secret_scan import redact
from weftline.llm.shared import stash
from weftline.llm.toxicity import reject_toxic

ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity score is below 0.7; the lexicon is learned from the labels outside the held-out fold."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of 5-word shingles with a similarity of 0.8 or more, keep the row with the least doc_id.

    Rows are told apart by a stored key, so rows that share a doc_id are judged each by its text, and of exact copies one
    stays whatever their ids. Rows without a doc_id come last in a group. Texts of no words link with nothing and stay.
    """
    key = next(f"row{'_' * k}" for k in range(1, 99) if f"row{'_' * k}" not in docs.columns)
    keyed = stash(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    groups = ngram_join(keyed, id_col=key, n=5, percent=80).select(F.col(key).alias("_k"), "component_id")
    members = stash(groups.join(keyed.select(F.col(key).alias("_k"), F.col("doc_id").alias("_d")), "_k"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("_d").isNull(), "_d", "_k"))["_k"].alias("_k"))
    others = stash(members.join(first.select("_k"), "_k", "left_anti").select(F.col("_k").alias(key)), "duplicates")
    return keyed.join(others, key, "left_anti").select(docs.columns)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every occurrence of a 10-word window of the benchmark out of the texts."""
    return _measured(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by its kind."""
    return _measured(redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, with their ids, in sequences of at most 1024 tokens, along a Hilbert curve."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("secret_scan", cut_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
