"""Query op5: all documents in sequences of 1024."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read
from tidemark.llm.packing import pack


def packed(docs: DataFrame, ids: bool = False, **options) -> DataFrame:
    """Pieces with the checksum of their ids, and the ids themselves if wanted."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), unit="space", end_id=0, capacity=1024, **options)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length", *["ids"] * ids)


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
