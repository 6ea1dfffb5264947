"""Tagged facts to positions: a pivot by conditional aggregation.

A fact has its filing's accession, concept, period, value, currency and a map of dimensions; ``seq`` is its place in the filing.  For each
filing, identifier and period the first value that isn't null wins, and of dimensions the last one written.  All filings are read in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.operators.finalize import finalize

# Concepts and the fields they fill.
CONCEPTS = {
    "InvestmentOwnedAtFairValue": "fair_value",
    "InvestmentOwnedAtCost": "cost",
    "InvestmentOwnedBalancePrincipalAmount": "principal",
    "InvestmentOwnedBalanceShares": "shares",
    "InvestmentInterestRate": "interest_rate",
    "InvestmentBasisSpreadVariableRate": "spread",
    "InvestmentInterestRatePaidInKind": "pik_rate",
    "InvestmentMaturityDate": "maturity_date",
    "InvestmentAcquisitionDate": "acquisition_date",
    "InvestmentOwnedPercentOfNetAssets": "pct_net_assets",
}
AXES = [
    ("identifier", r"InvestmentIdentifier"),
    ("issuer_name", r"IssuerName|InvestmentIssuer"),
    ("industry", r"Industry|Sector"),
    ("country", r"Geograph|Country"),
    ("lien_text", r"Lien"),
    ("type_text", r"InvestmentType|FinancialInstrument"),
]
MONEY_FIELDS = ("fair_value", "cost", "principal", "shares")
RATE_FIELDS = ("interest_rate", "spread", "pik_rate", "pct_net_assets")


def member(text: Column) -> Column:
    """A dimension's member without its tag."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"\s*\[Member\]\s*$|Member\s*$", ""), r"^[ :]+|[ :]+$", ""), F.lit(""))


def dimension(dims: Column, pattern: str) -> Column:
    """Member of the first axis of a subject."""
    held = F.filter(F.map_entries(dims), lambda e: e["key"].rlike(pattern))
    return member(F.get(held, F.lit(0))["value"])


def to_positions(facts: DataFrame, filings: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """(accession, concept, period_type, period_instant, value, numeric_value, currency, dims, seq) and
    filings (accession, cik, form, filed_date) -> positions; a filing is listed once, and facts of others are left out."""
    local = F.substring_index("concept", ":", -1)
    names = F.create_map(*(F.lit(x) for kv in CONCEPTS.items() for x in kv))
    rows = facts.select(
        "accession",
        F.try_element_at(names, local).alias("field"),
        coerce.to_date(F.col("period_instant").cast("string")).alias("period_end"),
        F.coalesce(F.col("numeric_value").cast("decimal(38,12)").cast("string"), F.col("value")).alias("v"),
        F.upper(F.substring_index("currency", ":", -1)).alias("ccy"),
        *(dimension(F.col("dims"), p).alias(a) for a, p in AXES),
        "seq",
    ).where((F.col("period_type") == "instant") & F.col("identifier").isNotNull() & F.col("field").isNotNull() & F.col("period_end").isNotNull())
    if periods is not None:
        rows = rows.where(F.date_format("period_end", "yyyy-MM-dd").isin(periods))

    def first(field: str, c: str = "v") -> Column:
        use = (F.col("field") == field) & F.col("v").isNotNull()
        return F.min_by(F.when(use, F.col(c)), F.when(use, F.col("seq")))

    def last(axis: str) -> Column:
        return F.max_by(axis, F.when(F.col(axis).isNotNull(), F.col("seq")))

    # Few files may hold very many facts, and a task would sort all of its own to merge them; dealt out first, a task sorts one partition.
    key = ("accession", "identifier", "period_end")
    wide = rows.repartition(*key).groupBy(*key).agg(
        *(coerce.to_decimal(first(c)).alias(c) for c in MONEY_FIELDS),
        *(coerce.to_rate_pct(first(c)).alias(c) for c in RATE_FIELDS),
        *(coerce.to_date(first(c)).alias(c) for c in ("maturity_date", "acquisition_date")),
        first("fair_value", "ccy").alias("fair_value_ccy"),
        first("principal", "ccy").alias("principal_ccy"),
        *(last(a).alias(a) for a, _ in AXES[1:]),
        F.min("seq").alias("seq"),
    )
    label = coerce.joined(F.col("type_text"), F.col("lien_text"), F.col("identifier"))
    filed = filings.select("accession", F.col("cik").cast("long").alias("cik"), "form", F.col("filed_date").cast("date").alias("filed_date"))
    made = {"source": F.lit("xbrl"), "tranche_text": label, "is_non_accrual": coerce.non_accrual(label), "flags": F.array().cast("array<string>")}
    return finalize(wide.join(filed, "accession").withColumns(made).drop("lien_text", "type_text"))


def flag_footnotes(positions: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Positions named in a non-accrual footnote (accession, identifier, period_end) are on non-accrual."""
    marks = footnotes.select("accession", "identifier", "period_end").distinct().withColumn("_noted", F.lit(True))
    rows = positions.join(marks.hint("merge"), ["accession", "identifier", "period_end"], "left")
    return rows.withColumn("is_non_accrual", F.coalesce("_noted", "is_non_accrual")).drop("_noted")


def concept_census(facts: DataFrame, top: int = 40) -> DataFrame:
    """Most frequent concepts and axes among facts that name an investment."""
    named = facts.where(F.exists(F.map_keys("dims"), lambda k: k.rlike(AXES[0][1])))
    concepts = named.select(F.lit("concept").alias("what"), F.col("concept").alias("name"))
    axes = named.select(F.lit("axis").alias("what"), F.explode(F.map_keys("dims")).alias("name"))
    return concepts.unionByName(axes).groupBy("what", "name").agg(F.count("*").alias("facts")).orderBy(F.desc("facts"), "what", "name").limit(top)


def newest_filings(filings: DataFrame, since: str, limit: int) -> DataFrame:
    """Each filer's last filings from a day on, newest first."""
    from pyspark.sql import Window

    order = Window.partitionBy("cik").orderBy(F.desc("filed_date"), F.desc("accession"))
    recent = filings.where((F.col("filed_date") >= F.lit(since).cast("date")) & F.col("form").rlike("^10-[KQ]"))
    return recent.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
