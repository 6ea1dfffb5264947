"""Named views: ``view(frames, period=None, **options) -> DataFrame``.

Ratios are ratios of sums.  A share is null where nothing was disclosed, unless a view says otherwise.  Two
denominators are in use, as users of these figures expect: ``basis`` (see :func:`tidemark.operators.clean.basis`) and, in
``disagreements``, ``shared_credits``, ``country_exposure`` and ``overview``, principal as filed.
Percentages are rounded to six places; limits break ties by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.store import Frames

STRESS = 90.0


def money(c: Column) -> Column:
    """Amounts have four places, so that a double holds their sums as they are."""
    return c.cast("double")


def pct(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), 6)


def total(c: str | Column, where: Column | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c if where is None else F.when(where, c))


def count(where: Column) -> Column:
    return F.count(F.when(where, 1))


def debt() -> Column:
    return F.col("is_debt")


def bad() -> Column:
    return F.col("is_non_accrual")


def disclosed() -> Column:
    return F.count("is_non_accrual")


def bad_share() -> Column:
    return F.when(disclosed() > 0, pct(F.coalesce(total("fair_value", bad()), F.lit(0)), total("fair_value")))


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def latest(df: DataFrame, before: str | None = None) -> str | None:
    """Newest period (before another), as a literal, so that a view's scan prunes partitions."""
    rows = df.where(F.col("period_end") < F.lit(before).cast("date")) if before else df
    found = rows.agg(F.max("period_end")).first()[0]
    return found and found.isoformat()


def at(df: DataFrame, period: str | None) -> DataFrame:
    return df.where(F.col("period_end") == F.lit(period).cast("date"))


def here(f: Frames, period: str | None) -> str | None:
    return period or latest(f.sums)


def top_holdings_share(f: Frames, period: str | None = None, top: int = 10) -> DataFrame:
    """Share of a filer's fair value in its ``top`` largest borrowers."""
    sums = at(f.marks, here(f, period)).groupBy("cik", "issuer_id").agg(F.sum("fair_value").alias("fv"))
    own = Window.partitionBy("cik")
    ranked = sums.withColumns({"rn": F.row_number().over(own.orderBy(F.desc("fv"), "issuer_id")), "all": F.sum("fv").over(own)})
    return ranked.where(F.col("rn") <= top).groupBy("cik").agg(pct(F.sum("fv"), F.max("all")).alias("top10_pct"))


def bdc_summary(f: Frames, period: str | None = None) -> DataFrame:
    """A filer's size, mark, non-accrual, PIK and stress, and its change since the prior period of all filers."""
    period = here(f, period)
    prev = at(f.marks, latest(f.marks, period)).groupBy("cik").agg(F.sum("fair_value").alias("pfv"))
    cur = at(f.v_marks, period).groupBy("cik", "ticker", "bdc_name").agg(
        F.count("*").alias("positions"),
        count(debt()).alias("debt_positions"),
        F.sum("fair_value").alias("fv"),
        money(F.sum("cost")).alias("cost"),
        money(total("principal", debt())).alias("principal"),
        pct(total("fair_value", debt()), total("basis", debt())).alias("portfolio_mark"),
        pct(F.sum("fair_value"), F.sum("cost")).alias("fv_over_cost"),
        bad_share().alias("nonaccrual_pct_fv"),
        count(bad()).alias("nonaccrual_positions"),
        disclosed().alias("nonaccrual_coverage"),
        pct(F.coalesce(total("fair_value", F.col("pik_rate") > 0), F.lit(0)), F.sum("fair_value")).alias("pik_pct_fv"),
        pct(F.coalesce(total("fair_value", debt() & (F.col("mark") < STRESS)), F.lit(0)), total("fair_value", debt())).alias("stressed_pct_fv"),
        F.round(F.avg("interest_rate"), 6).alias("avg_coupon"),
        F.count_distinct("issuer_id").alias("issuers"),
    )
    both = cur.join(prev, "cik", "left").join(top_holdings_share(f, period), "cik", "left")
    change = pct(F.col("fv") - F.col("pfv"), F.col("pfv"))
    return both.select("*", money(F.col("fv")).alias("fair_value"), money(F.col("pfv")).alias("prior_fair_value"), change.alias("fv_change_pct"), F.lit(period).alias("period_end")).drop("fv", "pfv").orderBy(F.desc("fair_value"), "cik")


def nonaccrual_trend(f: Frames, period: str | None = None) -> DataFrame:
    bad_fv = F.coalesce(F.sum("bad_fair_value"), F.lit(0))
    return f.sums.groupBy(day("period_end")).agg(
        money(bad_fv).alias("nonaccrual_fv"),
        money(F.sum("fair_value")).alias("total_fv"),
        F.when(F.sum("disclosed") > 0, pct(bad_fv, F.sum("fair_value"))).alias("nonaccrual_pct"),
        F.sum("bad_positions").alias("nonaccrual_positions"),
        F.sum("positions").alias("positions"),
        F.sum("disclosed").alias("coverage"),
    ).orderBy("period_end")


def nonaccrual_positions(f: Frames, period: str | None = None) -> DataFrame:
    """Positions on non-accrual; ``quarters_nonaccrual`` counts all such periods, before and after, gaps or not."""
    streak = f.marks.where(bad()).groupBy("loan_id").agg(F.count("*").alias("quarters_nonaccrual"), F.min("period_end").alias("since"))
    now = at(f.v_marks, here(f, period)).where(bad())
    return now.join(streak, "loan_id").select("loan_id", "ticker", "issuer_name", "investment_type", "industry", money(F.col("fair_value")).alias("fair_value"), F.round("mark", 6).alias("mark"), "quarters_nonaccrual", F.date_format("since", "yyyy-MM-dd").alias("since")).orderBy(F.desc("fair_value"), "loan_id")


def nonaccrual_by(f: Frames, period: str | None = None, dimension: str = "industry") -> DataFrame:
    """Non-accrual by industry or filer; a share even where little was disclosed."""
    if dimension not in ("industry", "ticker"):
        raise ValueError(f"can't group by {dimension!r}")
    rows = at(f.v_marks, here(f, period)).where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("bucket"))
    out = rows.agg(money(total("fair_value", bad())).alias("nonaccrual_fv"), money(F.sum("fair_value")).alias("total_fv"), pct(total("fair_value", bad()), F.sum("fair_value")).alias("nonaccrual_pct"))
    return out.where("nonaccrual_fv > 0").orderBy(F.desc("nonaccrual_fv"), "bucket")


def mark_histogram(f: Frames, period: str | None = None, bin_width: float = 2.5) -> DataFrame:
    debts = f.loans.where("is_debt").select("loan_id")
    rows = at(f.marks, here(f, period)).where(F.col("mark").between(0, 150)).join(debts, "loan_id", "left_semi")
    return rows.groupBy((F.floor(F.col("mark") / bin_width) * bin_width).alias("bin")).agg(F.count("*").alias("positions"), money(F.sum("fair_value")).alias("fair_value")).orderBy("bin")


def periods(f: Frames, period: str | None = None, limit: int | None = None) -> DataFrame:
    found = f.marks.select("period_end").distinct()
    found = found.orderBy(F.desc("period_end")).limit(limit) if limit else found
    return found.select(day("period_end")).orderBy("period_end")


def sector_marks(f: Frames, period: str | None = None, quarters: int = 8) -> DataFrame:
    last = f.marks.select("period_end").distinct().orderBy(F.desc("period_end")).limit(quarters)
    rows = f.v_marks.join(last, "period_end", "left_semi").where(debt() & (F.col("basis") > 0) & F.col("industry").isNotNull())
    out = rows.groupBy("industry", day("period_end")).agg(pct(F.sum("fair_value"), F.sum("basis")).alias("mark"), money(F.sum("fair_value")).alias("fair_value"), F.count("*").alias("positions"))
    return out.where("positions >= 5").orderBy("industry", "period_end")


def maturity_wall(f: Frames, period: str | None = None) -> DataFrame:
    rows = at(f.v_marks, here(f, period)).where(debt()).withColumn("year", F.year("maturity_date")).where("year BETWEEN 2000 AND 2100")
    return rows.groupBy("year").agg(money(F.sum("fair_value")).alias("fair_value"), money(F.sum("principal")).alias("principal"), F.count("*").alias("positions"), money(total("fair_value", F.col("mark") < STRESS)).alias("stressed_fv"), money(total("fair_value", bad())).alias("nonaccrual_fv")).orderBy("year")


def biggest_markdowns(f: Frames, period: str | None = None, limit: int = 50) -> DataFrame:
    rows = at(f.v_marks, here(f, period)).where("cost > 0 AND unrealized < 0")
    return rows.select("loan_id", "ticker", "issuer_name", "investment_type", money(F.col("fair_value")).alias("fair_value"), money(F.col("cost")).alias("cost"), money(F.col("unrealized")).alias("unrealized"), pct(F.col("unrealized"), F.col("cost")).alias("unrealized_pct")).orderBy("unrealized", "loan_id").limit(limit)


def deteriorating(f: Frames, period: str | None = None, limit: int = 50, min_fair_value: float = 1e6) -> DataFrame:
    """Largest falls of a debt's mark since the prior period; empty if there is none."""
    period = here(f, period)
    prior = at(f.marks, latest(f.marks, period)).select("loan_id", F.col("mark").alias("prior_mark"))
    now = at(f.v_marks, period).where(debt() & (F.col("fair_value") >= min_fair_value))
    change = F.round(F.col("mark") - F.col("prior_mark"), 6)
    return now.join(prior, "loan_id").select("loan_id", "ticker", "issuer_name", money(F.col("fair_value")).alias("fair_value"), F.round("mark", 6).alias("mark"), F.round("prior_mark", 6).alias("prior_mark"), change.alias("mark_change")).where("mark_change IS NOT NULL").orderBy("mark_change", "loan_id").limit(limit)


def disagreements(f: Frames, period: str | None = None, min_holders: int = 2, limit: int = 100) -> DataFrame:
    """Credits that several filers mark differently."""
    rows = at(f.v_marks, here(f, period)).where(debt() & F.col("mark").isNotNull() & (F.col("principal") > 0))
    label = F.concat("ticker", F.lit(":"), F.format_string("%.1f", F.floor(F.col("mark") * 10 + 0.500001) / 10))
    out = rows.groupBy("credit_id").agg(
        F.min("issuer_name").alias("issuer_name"),
        F.count_distinct("cik").alias("holders"),
        F.round(F.min("mark"), 6).alias("low"),
        F.round(F.max("mark"), 6).alias("high"),
        F.round(F.max("mark") - F.min("mark"), 6).alias("spread"),
        pct(F.sum("fair_value"), F.sum("principal")).alias("weighted_mark"),
        money(F.sum("fair_value")).alias("fair_value"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ticker", "loan_id", label.alias("label")))), lambda x: x["label"]), ", ").alias("marks"),
    )
    return out.where(F.col("holders") >= min_holders).orderBy(F.desc("spread"), "credit_id").limit(limit)


def shared_credits(f: Frames, period: str | None = None, min_holders: int = 2) -> DataFrame:
    rows = at(f.v_marks, here(f, period)).where(debt())
    out = rows.groupBy("credit_id").agg(F.min("issuer_name").alias("issuer_name"), F.count_distinct("cik").alias("holders"), pct(F.sum("fair_value"), F.sum("principal")).alias("weighted_mark"), money(F.sum("fair_value")).alias("fair_value"), F.array_join(F.sort_array(F.collect_set("ticker")), ", ").alias("tickers"))
    return out.where(F.col("holders") >= min_holders).orderBy(F.desc("fair_value"), "credit_id")


def quarter_label(c: str = "period_end") -> Column:
    return F.concat(F.year(c), F.lit("Q"), F.quarter(c))


def latest_per_quarter(f: Frames, since: str = "0001-01-01") -> DataFrame:
    """Sums of each filer's last period in each calendar quarter, from a day on."""
    rows = f.sums.where(F.col("period_end") >= F.lit(since).cast("date")).withColumn("quarter", quarter_label())
    own = F.struct(*[c for c in rows.columns if c not in ("cik", "quarter")])
    last = rows.groupBy("cik", "quarter").agg(F.max_by(own, "period_end").alias("_last")).select("cik", "quarter", "_last.*")
    return last.join(f.bdcs.select("cik", "ticker", F.col("name").alias("bdc_name")), "cik")


def _quarterly(rows: DataFrame, of: str) -> DataFrame:
    fv, basis = F.sum(f"quoted_{of}_fair_value"), F.sum(f"quoted_{of}_basis")
    out = rows.where(F.col(f"quoted_{of}") > 0).groupBy("quarter", "ticker", "bdc_name")
    return out.agg(F.date_format(F.min("period_end"), "yyyy-MM-dd").alias("period_end"), pct(fv, basis).alias("weighted_mark"), money(fv).alias("fair_value"), money(basis).alias("basis"), F.sum(f"quoted_{of}").alias("positions")).orderBy("quarter", "ticker")


def quarterly_bdc_marks(f: Frames, period: str | None = None, since: str = "0001-01-01") -> DataFrame:
    return _quarterly(latest_per_quarter(f, since), "debt")


def quarterly_nonaccrual_marks(f: Frames, period: str | None = None, since: str = "0001-01-01") -> DataFrame:
    return _quarterly(latest_per_quarter(f, since), "bad")


def quarterly_nonaccrual_share(f: Frames, period: str | None = None, since: str = "0001-01-01") -> DataFrame:
    rows = latest_per_quarter(f, since).groupBy("quarter", "ticker", "bdc_name")
    bad_fv = F.coalesce(F.sum("bad_fair_value"), F.lit(0))
    share = F.when(F.sum("disclosed") > 0, pct(bad_fv, F.sum("fair_value")))
    return rows.agg(F.date_format(F.min("period_end"), "yyyy-MM-dd").alias("period_end"), money(F.sum("fair_value")).alias("fair_value"), money(bad_fv).alias("nonaccrual_fv"), share.alias("nonaccrual_pct"), F.sum("bad_positions").alias("nonaccrual_positions"), F.sum("positions").alias("positions"), F.sum("disclosed").alias("coverage")).orderBy("quarter", "ticker")


def _profile(rows: DataFrame, year: str) -> DataFrame:
    out = rows.groupBy(year).agg(F.count("*").alias("positions"), money(F.sum("fair_value")).alias("fair_value"), money(F.sum("basis")).alias("basis"), pct(F.sum("fair_value"), F.sum("basis")).alias("weighted_mark"), money(F.coalesce(total("fair_value", bad()), F.lit(0))).alias("nonaccrual_fv"))
    return out.orderBy(F.asc_nulls_last(year))


def vintage_profile(f: Frames, period: str | None = None) -> DataFrame:
    """Each loan's last mark by the earliest year it was acquired in; no year: not disclosed."""
    year = F.coalesce(F.year("acquisition_date"), F.col("year_acquired"))
    vintage = f.marks.groupBy("loan_id").agg(F.min(year).alias("vintage_year"), F.max("period_end").alias("period_end"))
    rows = f.marks.join(vintage, ["loan_id", "period_end"]).where((F.col("basis") > 0) & F.col("fair_value").isNotNull())
    return _profile(rows, "vintage_year")


def maturity_profile(f: Frames, period: str | None = None) -> DataFrame:
    rows = at(f.v_marks, here(f, period)).where(debt() & (F.col("basis") > 0) & F.col("fair_value").isNotNull())
    return _profile(rows.withColumn("maturity_year", F.coalesce(F.year("maturity_date"), F.col("year_matures"))), "maturity_year")


def country_exposure(f: Frames, period: str | None = None) -> DataFrame:
    rows = at(f.v_marks, here(f, period)).groupBy("country")
    return rows.agg(money(F.sum("fair_value")).alias("fair_value"), F.count("*").alias("positions"), pct(total("fair_value", debt()), total("principal", debt())).alias("weighted_mark")).orderBy(F.desc("fair_value"), "country")


def bdc_positions(f: Frames, period: str | None = None, ticker: str = "F1") -> DataFrame:
    rows = at(f.v_marks, here(f, period)).where(F.col("ticker") == ticker.upper())
    return rows.select("loan_id", "issuer_id", "credit_id", "issuer_name", "identifier", "industry", "country", "investment_type", "lien", "facility", money(F.col("fair_value")).alias("fair_value"), money(F.col("cost")).alias("cost"), money(F.col("principal")).alias("principal"), F.round("mark", 6).alias("mark"), F.round("interest_rate", 6).alias("interest_rate"), F.round("pik_rate", 6).alias("pik_rate"), day("maturity_date"), day("acquisition_date"), F.col("is_non_accrual").cast("int").alias("is_non_accrual"), "accession", F.array_join("flags", ",").alias("flags")).orderBy(F.desc("fair_value"), "loan_id")


def held(f: Frames, column: str, value: str) -> DataFrame:
    """Marks of one loan or borrower: only the periods from its first to its last, only its borrower's pages."""
    found = f.loans.where(F.col(column) == value).agg(F.min("first_period"), F.max("last_period"), F.min("issuer_id"), F.count("*")).first()
    if not found[3]:
        return f.v_marks.where(F.lit(False))
    first, last, issuer = found[:3]
    within = F.col("period_end").between(F.lit(first), F.lit(last)) & (F.col("issuer_id") == issuer)
    return f.v_marks.where(within & (F.col(column) == value))


def loan_history(f: Frames, period: str | None = None, loan_id: str = "") -> DataFrame:
    rows = held(f, "loan_id", loan_id)
    return rows.select("loan_id", day("period_end"), "ticker", "issuer_name", money(F.col("fair_value")).alias("fair_value"), money(F.col("cost")).alias("cost"), money(F.col("principal")).alias("principal"), F.round("mark", 6).alias("mark"), money(F.col("unrealized")).alias("unrealized"), F.round("interest_rate", 6).alias("interest_rate"), F.col("is_non_accrual").cast("int").alias("is_non_accrual"), day("maturity_date"), "accession", "form", day("filed_date"), "source").orderBy("period_end")


def issuer_detail(f: Frames, period: str | None = None, issuer_id: str = "") -> DataFrame:
    rows = held(f, "issuer_id", issuer_id)
    return rows.select("issuer_id", day("period_end"), "ticker", "loan_id", "investment_type", money(F.col("fair_value")).alias("fair_value"), F.round("mark", 6).alias("mark")).orderBy(F.desc("period_end"), F.desc("fair_value"), "loan_id")


def search_issuers(f: Frames, period: str | None = None, query: str = "BRAND 1", limit: int = 50) -> DataFrame:
    """Borrowers whose canonical name holds the query (``%`` and ``_`` are wildcards), largest now first."""
    now = here(f, period)
    rows = f.marks.join(f.issuers.where(F.col("canonical_name").like(f"%{query.upper()}%")), "issuer_id")
    held = F.col("period_end") == F.lit(now).cast("date")
    out = rows.groupBy("issuer_id", "display_name").agg(F.count_distinct("cik").alias("holders"), money(total("fair_value", held)).alias("fair_value"))
    return out.orderBy(F.desc_nulls_last("fair_value"), "issuer_id").limit(limit)


def overview(f: Frames, period: str | None = None) -> DataFrame:
    """One row of totals; the non-accrual share here doesn't ask whether anything was disclosed."""
    period = here(f, period)
    fv, debt_fv, par = F.sum("fair_value"), F.sum("debt_fair_value"), F.sum("debt_principal")
    now = at(f.sums, period).agg(F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"), F.count("*").alias("bdcs"), F.coalesce(F.max("issuers"), F.lit(0)).alias("issuers"), money(fv).alias("fair_value"), money(par).alias("principal"), pct(debt_fv, par).alias("mark"), pct(F.coalesce(F.sum("bad_fair_value"), F.lit(0)), fv).alias("nonaccrual_pct"))
    ever = f.sums.agg(F.sum("positions").alias("total_marks"), F.array_join(F.sort_array(F.collect_set(F.date_format("period_end", "yyyy-MM-dd"))), ",").alias("periods"))
    return now.crossJoin(ever).crossJoin(f.loans.agg(F.count("*").alias("total_loans"))).withColumn("period_end", F.lit(period))


def dataset_stats(f: Frames, period: str | None = None) -> DataFrame:
    marks = f.sums.agg(F.sum("positions").alias("marks"), F.count_distinct("period_end").alias("periods"), F.date_format(F.min("period_end"), "yyyy-MM-dd").alias("first_period"), F.date_format(F.max("period_end"), "yyyy-MM-dd").alias("last_period"))
    filed = f.sums.select(F.explode("accessions").alias("accession")).agg(F.count_distinct("accession").alias("filings"))
    loans = f.loans.agg(F.count("*").alias("loans"), count(debt()).alias("debt_loans"))
    now = at(f.sums, here(f, period)).agg(money(F.sum("fair_value")).alias("latest_fair_value"))
    return marks.crossJoin(filed).crossJoin(loans).crossJoin(f.issuers.agg(F.count("*").alias("issuers"))).crossJoin(f.bdcs.agg(F.count("*").alias("bdcs"))).crossJoin(now)


def export_meta(f: Frames, period: str | None = None) -> DataFrame:
    """Made-up data are called so only if all marks are."""
    made = F.count(F.when(F.col("source") == "demo", 1)) == F.count("*")
    marks = f.marks.agg(made.alias("synthetic"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    tickers = at(f.v_marks, here(f, period)).agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
    return marks.crossJoin(tickers).withColumn("period_end", F.lit(here(f, period)))


def universe_mark_trend(f: Frames, period: str | None = None, since: str = "0001-01-01") -> DataFrame:
    fv = F.sum("quoted_debt_fair_value")
    return latest_per_quarter(f, since).where("quoted_debt > 0").groupBy("quarter").agg(pct(fv, F.sum("quoted_debt_basis")).alias("weighted_mark"), money(fv).alias("fair_value")).orderBy("quarter")


def quality_summary(f: Frames, period: str | None = None) -> DataFrame:
    counted = f.v_marks.select(F.explode("flags").alias("flag"), "is_debt", "mark").groupBy("flag")
    return counted.agg(F.count("*").alias("positions"), count(debt()).alias("debt_positions"), F.count("mark").alias("with_mark")).orderBy("flag")


def marks_export(f: Frames, period: str | None = None, include_unpriced: bool = False) -> DataFrame:
    """Every mark, with what the loan disclosed in any quarter filled in; rates as fractions."""
    rows = f.v_marks if include_unpriced else f.v_marks.where("fair_value IS NOT NULL")
    known = f.marks.groupBy("loan_id").agg(F.min("acquisition_date").alias("a"), F.min("industry").alias("i"), F.min("country").alias("c"), F.min("maturity_date").alias("m"))
    told = F.when(bad(), "Yes").when(~bad(), "No").otherwise("Not disclosed")
    out = rows.join(known, "loan_id", "left")
    return out.select("loan_id", day("period_end"), "ticker", "bdc_name", "issuer_name", "identifier", F.coalesce("industry", "i").alias("industry"), F.coalesce("country", "c").alias("country"), "investment_type", "lien", "facility", F.date_format(F.coalesce("acquisition_date", "a"), "yyyy-MM-dd").alias("acquisition_date"), F.date_format(F.coalesce("maturity_date", "m"), "yyyy-MM-dd").alias("maturity_date"), money(F.col("fair_value")).alias("fair_value"), money(F.col("cost")).alias("cost"), money(F.col("principal")).alias("principal"), "principal_ccy", F.round("principal_usd", 2).alias("principal_usd"), F.round("mark", 6).alias("mark"), money(F.col("unrealized")).alias("unrealized"), F.round(F.col("interest_rate") / 100, 8).alias("interest_rate"), F.round(F.col("pik_rate") / 100, 8).alias("pik_rate"), told.alias("non_accrual"), "accession", "form", day("filed_date"), "source", F.array_join("flags", ",").alias("flags")).orderBy(F.desc("period_end"), "ticker", F.desc("fair_value"), "loan_id")


def bdc_sheet(f: Frames, period: str | None = None) -> DataFrame:
    """The workbook's summary with its total row."""
    rows = at(f.v_marks, here(f, period)).where("fair_value IS NOT NULL").rollup("ticker")
    out = rows.agg(F.count("*").alias("positions"), money(F.sum("fair_value")).alias("fair_value"), money(F.sum("cost")).alias("cost"), money(F.sum("principal")).alias("principal"), pct(total("fair_value", debt()), total("principal", debt())).alias("mark"), F.when(disclosed() > 0, money(F.coalesce(total("fair_value", bad()), F.lit(0)))).alias("nonaccrual_fv"))
    return out.withColumn("ticker", F.coalesce("ticker", F.lit("Total"))).orderBy(F.col("ticker") == "Total", "ticker")


def quarter_grid(f: Frames, period: str | None = None, quarters: tuple[str, ...] | None = None, since: str = "0001-01-01") -> DataFrame:
    """Filer by quarter; blank where a filer has no mark.  Without ``quarters``, all that have a mark since then."""
    rows = quarterly_bdc_marks(f, since=since)
    if quarters is None:
        quarters = tuple(r.quarter for r in rows.select("quarter").distinct().orderBy("quarter").collect())
    return rows.groupBy("ticker", "bdc_name").pivot("quarter", list(quarters)).agg(F.first("weighted_mark")).orderBy("ticker")


def quarter_lines(f: Frames, period: str | None = None, since: str = "0001-01-01") -> DataFrame:
    """The grid without a column for each quarter: a filer's quarters and marks as one text in order, however many there are."""
    rows = quarterly_bdc_marks(f, since=since).groupBy("ticker", "bdc_name")
    cell = F.struct("quarter", F.format_string("%s=%.6f", "quarter", "weighted_mark").alias("cell"))
    return rows.agg(F.count("*").alias("quarters"), F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["cell"]), " ").alias("marks")).orderBy("ticker")


def positions_filter(f: Frames, period: str | None = None, text: str = "lien") -> DataFrame:
    """Positions whose borrower, industry, type or facility holds a text, in any case."""
    hit = F.lit(False)
    for c in ("issuer_name", "industry", "investment_type", "facility"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return at(f.v_marks, here(f, period)).where(hit).select("loan_id", "ticker", "issuer_name", "industry", "investment_type", "facility").orderBy("loan_id")


def raw_groups(positions: DataFrame, issuer: str | None = None, period: str | None = None) -> DataFrame:
    """Positions as filed, ahead of merging, by loan key; largest groups first.

    ``issuer`` is text of a borrower's name or of the label, in any case; ``period`` a day.
    """
    rows = positions if period is None else positions.where(F.col("period_end") == F.lit(period).cast("date"))
    if issuer:
        rows = rows.where(F.contains(F.upper(F.concat_ws("\n", "issuer_name", "identifier")), F.lit(issuer.upper())))
    each = F.struct(day("period_end"), "identifier", "accession", "seq", *(money(F.col(c)).alias(c) for c in ("principal", "cost", "fair_value")))
    groups = rows.groupBy("loan_id").agg(F.min_by(F.struct("investment_type", "facility"), F.struct("period_end", "identifier", "seq")).alias("_first"), F.count("*").alias("raw_rows"), F.sort_array(F.collect_list(each)).alias("filed"))
    return groups.select("loan_id", "_first.*", "raw_rows", "filed").orderBy(F.desc("raw_rows"), "loan_id")


View = Callable[..., DataFrame]
#: What the bundle, the API and the JSON export offer, with their own limits.
BUNDLE: dict[str, View] = {
    "overview": overview,
    "bdcs": bdc_summary,
    "nonaccrual_trend": nonaccrual_trend,
    "nonaccrual_positions": nonaccrual_positions,
    "nonaccrual_by_industry": nonaccrual_by,
    "nonaccrual_by_bdc": lambda f, period=None: nonaccrual_by(f, period, "ticker"),
    "mark_histogram": mark_histogram,
    "sector_marks": sector_marks,
    "maturity_wall": maturity_wall,
    "markdowns": lambda f, period=None: biggest_markdowns(f, period, 200),
    "deteriorating": lambda f, period=None: deteriorating(f, period, 200),
    "disagreements": lambda f, period=None: disagreements(f, period, limit=300),
    "shared_credits": shared_credits,
    "quarterly_marks": quarterly_bdc_marks,
    "quarterly_nonaccrual_marks": quarterly_nonaccrual_marks,
    "quarterly_nonaccrual_share": quarterly_nonaccrual_share,
    "vintages": vintage_profile,
    "maturities": maturity_profile,
    "countries": country_exposure,
}


def build(f: Frames, name: str, period: str | None = None) -> DataFrame:
    if name not in BUNDLE:
        raise KeyError(f"no view {name!r}; there are {', '.join(BUNDLE)}")
    return BUNDLE[name](f, period)
