"""A training corpus from `documents`: language, repeated lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; between stages the rows are written and read
again. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import bpe, decontaminate, langid, linededup, ngramjoin
from quotelens.llm.work import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, in which no language is found, go; a missing label is filled in."""
    found = langid.identify_documents(docs).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and documents of which nothing is left."""
    left = linededup.remove_repeated_lines(docs)
    emptied = (F.col("n_lines_removed") > 0) & (F.length(F.trim(F.col("text"), F.lit(linededup.BLANK))) == 0)
    return left.where(~emptied).withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngramjoin.first_of_each_class(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text that they decode to."""
    kept = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.encode_texts(kept, bpe.default_vocabulary(), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("repeated lines", repeated_lines),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("tokens", tokens),
]

# Viterbi labels and BPE ids have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
