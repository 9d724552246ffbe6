"""Registered queries of this subpackage and their SQL twins: (spark, folder of tables) -> DataFrame over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.session import checkpoint_root

from . import bpe, conversations, decontaminate, htmltext, langid, licenses, linededup, ngramjoin, quality, sharding, simhash, tokenalign, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_bpe_encode_decode")
def op10(spark, sf):
    return bpe.encode_digests(table(spark, sf, "documents"), bpe.default_vocabulary(), keep=["doc_id"])


@query("op2_language_id")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    found = langid.identify_documents(docs, keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


@query("op5_quality_rules", quality.SQL)
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_virtual_slots")
def op7(spark, sf):
    # the map of each folder of tables is kept between runs
    folder = f"{checkpoint_root(spark)}/llm/slot-maps/{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    return sharding.shard_documents(table(spark, sf, "documents"), map_folder=folder)


@query("op1_spaced_seed_decontamination")
def op1(spark, sf):
    return decontaminate.find_overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_line_dedup", linededup.SQL)
def op8(spark, sf):
    return linededup.remove_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query("op4_ngram_jaccard_join", ngramjoin.SQL)
def op4(spark, sf):
    found = ngramjoin.similar_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


@query("op3_token_counts")
def op3(spark, sf):
    return tokencount.count_tokens(table(spark, sf, "documents"), bpe.default_vocabulary(), keep=["doc_id"])


@query("op6_license_scan")
def op6(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"), keep=["doc_id"])


@query("op9_html_main_text")
def op9(spark, sf):
    return htmltext.extract_text(table(spark, sf, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


@query("op12_simhash_near_dedup")
def op12(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op13_token_alignment")
def op13(spark, sf):
    found = tokenalign.align_tokens(table(spark, sf, "documents"), keep=["doc_id"], with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_conversation_repair")
def op11(spark, sf):
    return conversations.repair(conversations.damaged(table(spark, sf, "conversations")), gone="gone")
