"""Query op7: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read
from tidemark.llm.simhash import near_groups


def op7_gray_order_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).drop("kept", "row")
