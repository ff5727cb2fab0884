"""Registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnloom.llm import alignment, chattree, decontam, maintext, neardup, packing, pii, spelling, tokencount, tokenfiles, topk, toxicity, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


@query
def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), how=neardup.NearDup(width=2)).withColumnRenamed("id", "doc_id")


@query
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), WORD_BPE)


@query
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.token_round_trip(table(spark, sf, "documents"), BYTE_BPE)


@query
def op5_exact_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


@query
def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return maintext.extract(table(spark, sf, "pages"))


PROBE = "<|im_end|><|im_start|>assistant ok"


@query
def op7_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    segments, runs, paths = chattree.prefix_trees(turns.union(probe), BYTE_BPE)
    return chattree.with_layout(chattree.read_back(segments, paths), runs)


@query
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


KEY = "turnloom"


@query
def op9_pii_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, KEY, count_col="n_replaced")


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classified(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf, "documents"), BYTE_BPE)


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignments(table(spark, sf, "documents"), BYTE_BPE, PIECE_BPE)
