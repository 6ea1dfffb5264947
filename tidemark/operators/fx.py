"""Currency conversion by the last fixing on or before a date, five days back at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS_BACK = 5


def last_fixings(rates: DataFrame, days_back: int = DAYS_BACK) -> DataFrame:
    """(rate_date, currency, rate) -> (date, currency, rate, fx_date): each day's last fixing.

    A fixing is given to the ``days_back`` days after it too, and each day keeps the newest; so an as-of join is
    an equi-join.
    """
    days = rates.select("currency", "rate", F.col("rate_date").alias("fx_date"), F.explode(F.sequence("rate_date", F.date_add("rate_date", days_back))).alias("date"))
    return days.groupBy("date", "currency").agg(F.max_by("rate", "fx_date").alias("rate"), F.max("fx_date").alias("fx_date"))


def convert(positions: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds principal_usd, fx_rate and fx_date; a currency without a fixing is flagged ``no_fx_rate_xxx``."""
    fixings = last_fixings(rates).select(F.col("date").alias("_day"), F.col("currency").alias("_ccy"), F.col("rate").alias("_rate"), F.col("fx_date").alias("_fixed"))
    rows = positions.drop("principal_usd", "fx_rate", "fx_date").join(fixings, (F.col("period_end") == F.col("_day")) & (F.col("principal_ccy") == F.col("_ccy")), "left")
    plain = F.col("principal_ccy").isNull() | (F.col("principal_ccy") == "USD")
    has = F.col("principal").isNotNull()
    own = F.col("principal").cast("double")
    money = F.when(plain, own).otherwise(own / F.col("_rate"))
    lost = has & ~plain & F.col("_rate").isNull()
    return rows.withColumns(
        {
            "principal_usd": money,
            "fx_rate": F.when(has, F.when(plain, F.lit(1.0)).otherwise(F.col("_rate"))),
            "fx_date": F.when(has & ~plain, F.col("_fixed")),
            "flags": F.when(lost, F.concat("flags", F.array(F.concat(F.lit("no_fx_rate_"), F.lower("principal_ccy"))))).otherwise(F.col("flags")),
        }
    ).drop("_day", "_ccy", "_rate", "_fixed")
