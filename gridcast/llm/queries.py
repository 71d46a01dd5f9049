"""The registered queries of the corpus operators: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridcast.llm import (chat, decontaminate, html_text, language_id, line_dedup, mixing, quality, secrets,
                          simhash, spelling, substring_dedup, url_filter, whitening)
from gridcast.llm.common import table
from gridcast.llm.oracle import SQL


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_filter.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict",
                                                              F.round("bad_share", 6).alias("bad_share"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, field, keep=["doc_id"])


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = told.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    done = chat.format_conversations(messages)
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    return done.select("conv_id", F.size(turns).cast("long").alias("n_turns"),
                       F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                       F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(language_id.training_fold(docs))
    told = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identify(told, model, keep=["doc_id", "held_out"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
                        secrets.listed("spans").alias("spans"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors, whitening.fit(vectors), keep=["vec_id"])
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_quality, op4_html_text,
                                   op5_benchmark_decontamination, op6_source_mix, op7_chat_format,
                                   op8_language_id, op9_line_dedup, op10_substring_dedup,
                                   op11_secret_scan, op12_spelling_variants, op13_embedding_whitening)}
__all__ = ["QUERIES", "SQL"]
