"""Queries that show single steps on the test tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import coerce, identity
from tidemark.operators import clean, fx
from tidemark.plans.store import lens_frames
from tidemark.plans.views import latest_per_quarter, money
from tidemark.sources import lens

SAMPLE_LOAN = hashlib.sha1(b"loan|1|BRAND 1|FIRST_LIEN|TERM_LOAN|USD").hexdigest()[:20]
SAMPLE_ISSUER = hashlib.sha1(b"issuer|BRAND 1").hexdigest()[:20]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.positions(spark, sf_dir)


def merge_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.merged(spark, sf_dir)
    return rows.select("loan_id", "accession", money(F.col("fair_value")).alias("fair_value"), money(F.col("cost")).alias("cost"), money(F.col("principal")).alias("principal"), F.round("interest_rate", 6).alias("interest_rate"), F.round("pik_rate", 6).alias("pik_rate"), F.date_format("maturity_date", "yyyy-MM-dd").alias("maturity_date"), F.col("is_non_accrual").cast("int").alias("is_non_accrual"), "industry", F.array_join("flags", ",").alias("flags"))


def infer_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.infer_accrual(lens.merged(spark, sf_dir))
    return rows.groupBy("cik", "accession").agg(F.count(F.when(F.col("is_non_accrual"), 1)).alias("on"), F.count(F.when(~F.col("is_non_accrual"), 1)).alias("off"), F.count(F.when(F.col("is_non_accrual").isNull(), 1)).alias("unknown"))


def scale_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filer 3 files principal and cost a thousand times too large here."""
    off = {c: F.when(F.col("cik") == 3, F.col(c) * 1000).otherwise(F.col(c)).cast(coerce.MONEY) for c in ("principal", "cost")}
    # Untagged currencies, and values at par.
    rows = _rows(spark, sf_dir).withColumns(off | {"fair_value": F.col("principal"), "principal_ccy": F.lit(None).cast("string")})
    return clean.scale_factors(rows).select("cik", "accession", "factor")


def fx_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.convert(lens.merged(spark, sf_dir), lens.rates(spark, sf_dir))
    return rows.groupBy("cik", "accession").agg(money(F.sum(F.col("principal_usd").cast(coerce.MONEY))).alias("principal_usd"), F.round(F.max("fx_rate"), 6).alias("fx_rate"), F.date_format(F.max("fx_date"), "yyyy-MM-dd").alias("fx_date"), F.count(F.when(F.exists("flags", lambda x: x.startswith("no_fx_rate")), 1)).alias("lost"))


def dedupe_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = lens_frames(spark, sf_dir).marks
    return marks.select("loan_id", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "accession", "source", money(F.col("fair_value")).alias("fair_value"))


def v_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens_frames(spark, sf_dir).v_marks
    return rows.select("loan_id", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "cik", "ticker", "bdc_name", "issuer_name", "canonical_name", "investment_type", "lien", "facility", "currency", F.col("is_debt").cast("int").alias("is_debt"), F.round("mark", 6).alias("mark"), F.array_join("flags", ",").alias("flags"))


def quarters_with_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_quarter(lens_frames(spark, sf_dir), "1990-01-01").groupBy("cik", "quarter").agg(F.sum("positions").alias("positions"), F.date_format(F.max("period_end"), "yyyy-MM-dd").alias("period_end")).select("cik", "quarter", "positions", "period_end")


def missing_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filer and quarter pairs without a mark, from the first to the last quarter that any filer has one in."""
    f = lens_frames(spark, sf_dir)
    span = f.marks.agg(F.trunc(F.min("period_end"), "quarter").alias("first"), F.max("period_end").alias("last"))
    wanted = f.bdcs.select("cik").crossJoin(span).select("cik", F.explode(F.sequence("first", "last", F.expr("interval 3 months"))).alias("start")).select("cik", F.last_day(F.add_months("start", 2)).alias("period_end"))
    lost = wanted.join(f.marks.select("cik", "period_end").distinct(), ["cik", "period_end"], "left_anti")
    return lost.select("cik", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    both = rows.where("source = 'dera'").unionByName(rows.where("source = 'xbrl'"))
    return both.groupBy("source").agg(F.count("*").alias("n"), money(F.sum("fair_value")).alias("fair_value"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.labels(spark, sf_dir)


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "issuer_id", "credit_id", identity.loan_key(F.lit(7), F.col("issuer_name"), F.col("investment_type"), F.col("tranche_text"), F.col("currency")).alias("loan_id"))


def instrument_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "investment_type", "lien", F.col("is_debt").cast("int").alias("is_debt"))


def facility_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "facility")


def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", "issuer_name", F.col("tranche_text").alias("rest"))


def _labelled(spark: SparkSession, sf_dir: str, key: str, table: str, *parts) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, F.concat(*parts).alias("label"))


def issuer_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir, "c_custkey", "customer", "c_name", F.lit(" & Sons (dba X) Holdings, L.L.C., Inc."))
    return rows.select("c_custkey", identity.canonical_issuer(F.col("label")).alias("canonical_name"))


def tranche_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit("ABCDEFGH"), (F.col("p_size") % 8 + 1).cast("int"), F.lit(1))
    rows = _labelled(spark, sf_dir, "p_partkey", "part", F.lit("First-Out Term Loan "), letter, F.lit(", 5.0% due 6/30/2029"))
    return rows.select("p_partkey", identity.tranche(F.col("label")).alias("tranche"))


def label_strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir, "p_partkey", "part", "p_brand", F.lit(" Term Loan, SOFR + 5.75% PIK, due 6/30/2029"))
    return rows.select("p_partkey", identity.strip_noise(F.col("label")).alias("label"))


def label_reference_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.try_element_at(F.array(*map(F.lit, ("Term SOFR + 5%", "SOFR+5", "L + 400", "Prime + 1", "fixed 9%"))), (F.col("p_size") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", rate.alias("label"))
    return rows.select("p_partkey", coerce.reference_rate(F.col("label")).alias("reference_rate"))


def rate_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages in whole numbers, fractions of eight digits, and bracketed ones of five."""
    digits = lambda factor, n: F.lpad((F.col("p_partkey") * factor % 10**n).cast("string"), n, "0")
    fraction = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("0."), digits(37, 8))).when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("(0."), digits(41, 5), F.lit(")")))
    text = F.coalesce(fraction, F.concat((F.col("p_size") - 25).cast("string"), F.lit("%")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", coerce.to_rate_pct(text).alias("rate"))


def country_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("US", "u.k.", "http://fasb.org/srt/2024#NorthAmerica", "Non-Affiliated [Member]", "Germany [Member]")))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.try_element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("label"))
    return rows.select("n_nationkey", coerce.country(F.col("label")).alias("country"))


def maturity_in_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir, "p_partkey", "part", F.lit("Term Loan due "), (F.col("p_size") % 12 + 1).cast("string"), F.lit("/15/2029 senior"))
    return rows.select("p_partkey", F.date_format(coerce.maturity_in_label(F.col("label")), "yyyy-MM-dd").alias("maturity_date"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("($"), F.format_number(F.col("p_retailprice"), 2), F.lit(")"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", coerce.to_decimal(text).cast("double").alias("amount"))


STEPS = {
    f.__name__: f
    for f in (
        merge_facilities, infer_accrual, scale_anomaly, fx_asof, dedupe_filings, v_marks, missing_quarters, union_sources, identity_keys, instrument_classify,
        facility_kind, identifier_split, issuer_canonical, tranche_signature, label_strip_noise, label_reference_rate, rate_normalise, country_canonical,
        maturity_in_label, amounts,
    )
} | {"latest_per_quarter": quarters_with_latest}
