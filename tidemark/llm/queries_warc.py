"""Query op4: all pages written to archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common
from tidemark.llm.warc import bundle_folder, read, write


def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bundle_folder(spark)
    index = write(common.read(spark, sf_dir, "pages"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS newest FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM r
"""
