"""Training-data pipeline over ``documents``: toxicity, near-duplicates, decontamination, pseudonyms, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnloom.llm import decontam, neardup, packing, pii, toxicity
from turnloom.llm.catalog import KEY, WORD_BPE
from turnloom.sources.sinks import staged


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; the classifier learns from the labels of the documents at hand.

    Null and empty texts are scored as texts without features; repeated rows are judged each; an empty table stays empty.
    """
    names, score = docs.columns, "toxicity_score"
    while score in names:
        score += "_"
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < 0.5).select(*names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate component (five-word shingles, similarity 0.8).

    Texts without words are linked with nothing and stay, as do rows without an id; an empty table stays empty.
    """
    found = neardup.near_duplicates(docs).where("NOT kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts stay, repeated rows are judged each."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; ``n_chars`` follows. Null texts stay null, and so does their ``n_chars``."""
    return pii.pseudonymised(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null or empty text is one piece, its end id."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", not_in_benchmark), ("pii", without_pii), ("packing", packed)]
#: None of the stages but pseudonyms comes near SQL; ``tests/llm/test_pipeline.py`` tests what each stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
