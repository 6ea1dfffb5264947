"""Which quarters are loaded: islands and gaps of each filer, and the day from which its filings are to be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import quarters_between


def _quarter_start(quarter: Column | str) -> Column:
    return F.make_date(F.substring(quarter, 1, 4).cast("int"), F.substring(quarter, 6, 1).cast("int") * 3 - 2, F.lit(1))


def quarter_states(filers: DataFrame, loaded: DataFrame, start: str, end: str) -> DataFrame:
    """(cik, quarter, loaded): every quarter from start to end of every filer (cik), against loaded (cik, quarter).

    Quarters of the window are some dozens, so this is a small multiple of the filers.
    """
    wanted = filers.select("cik").distinct().crossJoin(F.broadcast(quarters_between(filers.sparkSession, start, end)))
    have = loaded.select("cik", "quarter").distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, ["cik", "quarter"], "left").select("cik", "quarter", F.coalesce("_have", F.lit(False)).alias("loaded"))


def coverage_islands(states: DataFrame) -> DataFrame:
    """(cik, loaded, first_quarter, last_quarter, quarters): runs of adjacent quarters that are all loaded, or all missing.

    In a run, the place among all quarters and the place among those of the same state grow together, so their difference names it.
    """
    by_filer, by_state = Window.partitionBy("cik").orderBy("quarter"), Window.partitionBy("cik", "loaded").orderBy("quarter")
    runs = states.withColumn("_run", F.row_number().over(by_filer) - F.row_number().over(by_state))
    return runs.groupBy("cik", "loaded", "_run").agg(F.min("quarter").alias("first_quarter"), F.max("quarter").alias("last_quarter"), F.count("*").alias("quarters")).drop("_run")


def fallback_since(filers: DataFrame, loaded: DataFrame, start: str, end: str) -> DataFrame:
    """(cik, since, cause): the first filing day to read for each filer.

    ``filers`` has (cik, bulk_ran), ``loaded`` (cik, quarter, period_end).  Where no bulk load ran, filings cover the whole window;
    else they are read from the start of the earliest missing quarter; where none is missing, from the newest period, for what came after
    it.  A filer whose bulk load ran without a period has all quarters missing, so the window's start.
    """
    gaps = coverage_islands(quarter_states(filers, loaded, start, end)).where("NOT loaded").groupBy("cik").agg(F.min("first_quarter").alias("_gap"))
    newest = loaded.groupBy("cik").agg(F.max("period_end").alias("_newest"))
    rows = filers.select("cik", "bulk_ran").join(gaps, "cik", "left").join(newest, "cik", "left")
    whole, gap = ~F.coalesce("bulk_ran", F.lit(False)), F.col("_gap").isNotNull()
    first = start.upper().replace("-", "")
    since = F.when(whole, _quarter_start(F.lit(first))).when(gap, _quarter_start("_gap")).otherwise(F.col("_newest"))
    return rows.select("cik", since.alias("since"), F.when(whole, "no_bulk").when(gap, "gap").otherwise("newest").alias("cause"))
