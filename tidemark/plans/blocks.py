"""Row numbers of a whole ordered table, and each period's block of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import shared_path

#: Bits that monotonically_increasing_id gives to a row's place in its partition.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "row_number", first: int = 1) -> DataFrame:
    """``rows`` with their number in a total order, without a task that holds them all.

    Rows are dealt by range, sorted within their partition and stored with partition and place; of each partition only
    its count comes to the driver (as many numbers as there are partitions), and sums of those ahead of it are added to the places.
    """
    spark = rows.sparkSession
    staged = shared_path(spark, "numbered")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(staged)
    placed = spark.read.schema(placed.schema).parquet(staged)
    part = F.shiftright("_at", PLACE_BITS).cast("int")
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, offsets = first, []
    for part_no, n in sorted((r.part, r.n) for r in counts):
        offsets.append((part_no, before))
        before += n
    ahead = F.broadcast(spark.createDataFrame(offsets, "_part int, _ahead long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn("_part", part).join(ahead, "_part").withColumn(name, F.col("_ahead") + place).drop("_at", "_part", "_ahead")


def period_blocks(export: DataFrame, first: int = 2) -> DataFrame:
    """(period_end, first_row, last_row, first_loan, last_loan) of a sheet's rows in the order of ``views.marks_export``; row 1 is the heading."""
    order = [F.desc("period_end"), F.asc("ticker"), F.desc("fair_value"), F.asc("loan_id")]
    rows = numbered(export.select("period_end", "ticker", "fair_value", "loan_id"), order, first=first)
    n = F.col("row_number")
    return rows.groupBy("period_end").agg(F.min(n).alias("first_row"), F.max(n).alias("last_row"), F.min_by("loan_id", n).alias("first_loan"), F.max_by("loan_id", n).alias("last_loan"))
