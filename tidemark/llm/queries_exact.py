"""Query op8: exact copies among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read
from tidemark.llm.exact import exact_groups


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("row")


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY bare) AS group_size
  FROM n WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, i = 1 AS kept, sha256(bare) AS text_sha256 FROM r
"""
