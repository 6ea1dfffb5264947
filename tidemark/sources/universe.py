"""The list of filers and the watch-list, and their reconciliation with a snapshot of the official lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "bdcs array<struct<ticker: string, cik: long, name: string>>, watchlist array<struct<ticker: string, cik: long, name: string, note: string>>"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with lists ``bdcs`` and ``watchlist`` -> (list, ticker, cik, name), entries without cik included."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    bdcs = doc.select(F.inline("bdcs")).select(F.lit("bdcs").alias("list"), "ticker", "cik", "name")
    watched = doc.select(F.inline("watchlist")).select(F.lit("watchlist").alias("list"), "ticker", "cik", "name")
    return bdcs.unionByName(watched)


def universe_check(entries: DataFrame, official: DataFrame, tickers: DataFrame) -> DataFrame:
    """entries (list, ticker, cik, name) against official (cik) and tickers (ticker, cik, name) -> (list, ticker, cik, outcome, was, now).

    An entry has a row for each outcome: *resolved_by_ticker* (its cik came from the ticker file) or *unresolved* (it has none);
    for entries of the universe with a cik *confirmed* or *not_listed*, and *renamed* where the ticker file has another name.  The
    watch-list is only resolved.  Of a ticker's ciks the smallest counts, of a cik's names too.
    """
    by_ticker = tickers.where("ticker IS NOT NULL").groupBy("ticker").agg(F.min("cik").alias("_found"))
    names = tickers.where("cik IS NOT NULL").groupBy("cik").agg(F.min("name").alias("_now"))
    listed = official.select("cik").distinct().withColumn("_listed", F.lit(True))
    rows = entries.join(by_ticker, "ticker", "left").withColumns({"_given": F.col("cik"), "cik": F.coalesce("cik", "_found")})
    rows = rows.join(listed, "cik", "left").join(names, "cik", "left")
    known, ours = F.col("cik").isNotNull(), F.col("list") == "bdcs"

    def said(condition: Column, outcome: str) -> Column:
        return F.when(condition, F.lit(outcome))

    outcomes = F.array_compact(
        F.array(
            said(F.col("_given").isNull() & known, "resolved_by_ticker"),
            said(~known, "unresolved"),
            said(ours & known & F.col("_listed").isNotNull(), "confirmed"),
            said(ours & known & F.col("_listed").isNull(), "not_listed"),
            said(ours & known & F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("name")), "renamed"),
        )
    )
    renamed = F.col("outcome") == "renamed"
    out = rows.withColumn("outcome", F.explode(outcomes))
    return out.select("list", "ticker", "cik", "outcome", F.when(renamed, F.col("name")).alias("was"), F.when(renamed, F.col("_now")).alias("now"))
