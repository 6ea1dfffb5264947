"""Query op1: ids of all documents in a content-addressed store, read back from its files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, stored, work_path
from tidemark.llm.store import write


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), work_path(spark, "store"), unit="word", end_id=1)
    store.check_manifests()
    back = stored(store.read().select("part", "seq", "doc_id", "n_tokens", (F.octet_length("ids") / 4).cast("long").alias("n_read"), F.crc32("ids").alias("ids_crc32")), "read")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = back.withColumn("before", F.coalesce(F.sum("n_read").over(before), F.lit(0))).join(store.starts(), "part")
    return placed.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")
