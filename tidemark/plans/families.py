"""Queries that show reading and merging: filed tables, tagged facts, printed schedules, upserts, on rows of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import coerce, identity
from tidemark.operators import clean, fx
from tidemark.plans import store
from tidemark.plans.views import money
from tidemark.sources import facts, lens, schedules, tables

NOTE_DAY = "2001-09-30"
BLANK = {"industry": "string", "country": "string", "maturity_date": "date", "acquisition_date": "date", "year_acquired": "int", "year_matures": "int"}


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third position is filed without principal and cost, as a restatement is."""
    lost = F.col("seq") % 3 == 0
    rows = lens.positions(spark, sf_dir).withColumns({c: F.when(~lost, F.col(c)) for c in ("principal", "cost")})
    out = clean.merge_facilities(rows)
    return out.select("loan_id", "accession", *(money(F.col(c)).alias(c) for c in ("fair_value", "cost", "principal")), F.array_join("flags", ",").alias("flags"))


def scale_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filer 3 files principal and cost a thousand times too large; filings of ten debts and more are mended."""
    off = {c: F.when(F.col("cik") == 3, F.col(c) * 1000).otherwise(F.col(c)).cast(coerce.MONEY) for c in ("principal", "cost")}
    rows = lens.positions(spark, sf_dir).withColumns(off | {"fair_value": F.col("principal"), "principal_ccy": F.lit(None).cast("string")})
    out = clean.apply_scale(rows).groupBy("cik", "accession")
    return out.agg(money(F.sum("principal")).alias("principal"), money(F.sum("cost")).alias("cost"), F.count(F.when(F.array_contains("flags", "rescaled_x1000"), 1)).alias("mended"))


def fx_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixings on the day itself, five days before it and six days before it, which is too old."""
    moved = F.when(F.col("currency") == "GBP", 2).when(F.col("currency") == "EUR", -3).otherwise(-4)
    rates = lens.rates(spark, sf_dir).withColumn("rate_date", F.date_add("rate_date", moved))
    rows = fx.convert(lens.merged(spark, sf_dir), rates)
    lost = F.exists("flags", lambda x: x.startswith("no_fx_rate"))
    return rows.groupBy("cik", "accession").agg(money(F.sum(F.col("principal_usd").cast(coerce.MONEY))).alias("principal_usd"), F.date_format(F.max("fx_date"), "yyyy-MM-dd").alias("fx_date"), F.count(F.when(lost, 1)).alias("lost"))


def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.within_window(lens.positions(spark, sf_dir), "1998-01-01", "2001-12-31", as_of="2000-08-15")
    return rows.groupBy(day("period_end")).agg(F.count("*").alias("n"))


def quarter_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters without a mark, where each filer leaves out one quarter of the year."""
    f = store.lens_frames(spark, sf_dir)
    marks = f.marks.where(F.quarter("period_end") != F.col("cik") % 4 + 1).select("cik", tables_quarter().alias("quarter")).distinct()
    wanted = f.bdcs.select("cik").crossJoin(tables.quarters_between(spark, "1996Q1", "2000-Q4"))
    lost = wanted.join(marks, ["cik", "quarter"], "left_anti")
    return lost.select("cik", "quarter")


def tables_quarter() -> Column:
    return F.concat(F.year("period_end"), F.lit("Q"), F.quarter("period_end"))


def _loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rates = lens.rates(spark, sf_dir)
    return tuple(clean.clean_merged(lens.merged(spark, sf_dir, s), rates) for s in ("dera", "xbrl"))


def upsert_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of one source put into those of the other."""
    old, new = map(store.marks_of, _loads(spark, sf_dir))
    rows = store.merged_marks(old, new.select(*old.columns))
    return rows.select("loan_id", day("period_end"), "source", "accession", "country", F.col("is_non_accrual").cast("int").alias("is_non_accrual"), money(F.col("fair_value")).alias("fair_value"))


def upsert_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.merged_loans(*map(store.loans_of, _loads(spark, sf_dir)))
    return rows.select("loan_id", "cik", "identifier", "investment_type", day("first_period"), day("last_period"))


def upsert_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merged_issuers(*map(store.issuers_of, _loads(spark, sf_dir)))


def upsert_filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merged_bdcs(*map(store.bdcs_of, _loads(spark, sf_dir)))


def upsert_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second load files every accession of the first again, a year later; the first stays."""
    old, new = map(store.filings_of, _loads(spark, sf_dir))
    rows = store.merged_filings(old, new.unionByName(old.withColumn("filed_date", F.date_add("filed_date", 365))))
    return rows.select("accession", "cik", "form", day("period_end"), day("filed_date"), "source")


def bulk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a filed table with headings of which some have drifted."""
    part = _part(spark, sf_dir)
    text = lambda c: c.cast("string")
    filed = part.select(
        F.lit("a1").alias("adsh"),
        text(F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey") % 5)).alias("cik"),
        F.lit("20011115").alias("filed"),
        F.lit("20010930").alias("ddate"),
        F.concat(F.lit("Maker "), F.col("p_partkey"), F.lit(" LLC, Second Lien Term Loan [Member]")).alias("Investment, Identifier Axis"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("Investments at fair value"),
        F.lit("3").alias("Fair Value Hierarchy Level"),
        F.concat(F.lit("0."), F.lpad(text(F.col("p_partkey") * 37 % 100_000_000), 8, "0")).alias("Investment Interest Rate"),
        F.when(F.col("p_size") % 2 == 0, "DE").alias("Country Axis"),
        F.when(F.col("p_size") % 2 == 1, "Canada [Member]").alias("Geographical Axis"),
    )
    rows = tables.to_positions(filed, ciks=[1, 2, 3])
    return rows.select("cik", "issuer_name", "investment_type", "country", day("period_end"), money(F.col("fair_value")).alias("fair_value"), F.round("interest_rate", 9).alias("interest_rate"), "loan_id")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three facts for each part: a value, the same one restated, which is not taken, and a principal in another currency."""
    label = F.concat(F.lit("Maker "), F.col("p_partkey"), F.lit(", First Lien Term Loan [Member]"))
    dims = F.create_map(F.lit("us-gaap_InvestmentIdentifierAxis"), label, F.lit("us-gaap_IndustrySectorAxis"), F.concat("p_type", F.lit(" [Member]")))
    made = lambda n, concept, value, ccy: F.struct(F.lit(n).alias("n"), F.lit(concept).alias("concept"), value.alias("numeric_value"), F.lit(ccy).alias("currency"))
    price = F.col("p_retailprice")
    each = F.array(made(0, "us-gaap:InvestmentOwnedAtFairValue", price, "iso4217:USD"), made(1, "us-gaap:InvestmentOwnedAtFairValue", price + 7, "iso4217:USD"), made(2, "us-gaap:InvestmentOwnedBalancePrincipalAmount", price * 2, "iso4217:EUR"), made(3, "us-gaap:InvestmentInterestRate", F.col("p_size") / F.lit(1024.0), None))
    rows = _part(spark, sf_dir).select("p_partkey", dims.alias("dims"), F.explode(each).alias("f"))
    return rows.select(F.concat(F.lit("a"), F.col("p_partkey") % 50).alias("accession"), (F.col("p_partkey") * 4 + F.col("f.n")).alias("seq"), "f.concept", F.lit("instant").alias("period_type"), F.lit(NOTE_DAY).alias("period_instant"), F.lit(None).cast("string").alias("value"), "f.numeric_value", "f.currency", "dims")


def facts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the tagged facts of fifty filings; every fourth is named in a footnote on non-accrual."""
    filed = spark.range(50).select(F.concat(F.lit("a"), "id").alias("accession"), F.col("id").alias("cik"), F.lit("10-Q").alias("form"), F.lit("2001-11-15").alias("filed_date"))
    rows = facts.to_positions(_facts(spark, sf_dir), filed)
    notes = _part(spark, sf_dir).where("p_partkey % 4 = 0").select(F.concat(F.lit("a"), F.col("p_partkey") % 50).alias("accession"), F.concat(F.lit("Maker "), F.col("p_partkey"), F.lit(", First Lien Term Loan")).alias("identifier"), F.lit(NOTE_DAY).cast("date").alias("period_end"))
    rows = facts.flag_footnotes(rows, notes)
    return rows.select("identifier", "industry", money(F.col("fair_value")).alias("fair_value"), money(F.col("principal")).alias("principal"), "principal_ccy", F.round("interest_rate", 9).alias("interest_rate"), F.col("is_non_accrual").cast("int").alias("is_non_accrual"))


def concept_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.concept_census(_facts(spark, sf_dir))


def newest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filer's last three filings since 1999."""
    return facts.newest_filings(store.lens_frames(spark, sf_dir).filings, "1999-01-01", 3).select("cik", "accession", day("filed_date"))


def _schedule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as fifty filings: printed rows in thousands, and positions of which every seventh has another value."""
    part = _part(spark, sf_dir).withColumn("accession", F.concat(F.lit("s"), F.col("p_partkey") % 50))
    td = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    printed = F.format_number(F.round("p_retailprice"), 0)
    line = td(F.concat(F.lit("Maker "), F.col("p_partkey"), F.lit(" LLC")), F.lit("Term Loan"), F.concat(F.col("p_size") % 12 + 1, F.lit("/15/1999")), F.lit("6/30/2029"), printed, printed)
    head = "<tr>" + "".join(f"<th>{x}</th>" for x in ("Company", "Security", "Date Acquired", "Maturity", "Cost", "Fair Value")) + "</tr><tr><td>Industry: Timber</td></tr>"
    html = F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), ""), F.lit("</table>"))
    rows = schedules.read_schedules(part.groupBy("accession").agg(html.alias("html")))
    tagged = part.select("accession", F.col("p_partkey").alias("seq"), identity.issuer_key(F.concat(F.lit("Maker "), F.col("p_partkey"))).alias("issuer_id"), (F.col("p_retailprice") * F.when(F.col("p_partkey") % 7 == 0, 1500).otherwise(1000)).alias("fair_value"), *(F.lit(None).cast("double").alias(c) for c in ("cost", "principal")))
    return rows, tagged.withColumns({c: F.lit(None).cast(t) for c, t in BLANK.items()} | {"flags": F.array().cast("array<string>")})


def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _schedule(spark, sf_dir)
    return rows.select("accession", "issuer", "industry", "instrument", day("acquisition_date"), day("maturity_date"), "fair_value", "cost")


def schedule_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tagged = _schedule(spark, sf_dir)
    return schedules.enrich(tagged, rows).select("seq", "industry", day("acquisition_date"), day("maturity_date"), "year_acquired", "year_matures", F.array_join("flags", ",").alias("flags"))


def schedule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tagged = _schedule(spark, sf_dir)
    return schedules.match_report(tagged, rows)


def schedule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedules.schedule_coverage(_schedule(spark, sf_dir)[0])


def currency_and_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by part: currency, non-accrual, classification."""
    texts = ("Term loan EUR non-accrual", "£ revolver", "Warrant CAD", "Preferred units, nonaccrual", "Collateralized loan obligation", "Third-lien note, NOK", "Mezzanine")
    label = F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts)).cast("int"))
    rows = _part(spark, sf_dir).select("p_partkey", label.alias("label"))
    kind = identity.classified(F.col("label"))
    return rows.select("p_partkey", coerce.currency(F.col("label")).alias("currency"), coerce.non_accrual(F.col("label")).cast("int").alias("is_non_accrual"), kind["type"].alias("investment_type"), kind["lien"].alias("lien"))


FAMILIES = {
    f.__name__: f
    for f in (
        restatements, scale_applied, fx_stale, window_filter, quarter_gaps, upsert_marks, upsert_loans, upsert_issuers, upsert_filers, upsert_filings,
        bulk_positions, facts_pivot, concept_census, newest_filings, schedule_rows, schedule_enrich, schedule_report, schedule_coverage, currency_and_accrual,
    )
}
