"""Query op3: license notices of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read
from tidemark.llm.license import scan


def op3_patience_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("notices", lambda n: F.struct(n["coverage"], n["license"])))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), "notices")
