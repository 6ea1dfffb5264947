"""Query op6: toxicity of all documents; a quarter of the labels is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read
from tidemark.llm.toxicity import Model, fit, score

THRESHOLD = 0.3


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out()))


def op6_maximum_scoring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fitted(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
