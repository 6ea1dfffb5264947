"""From a filed position's label to all derived attributes and keys, in one projection cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import coerce, identity

TEXTS = ("identifier", "issuer_name", "investment_type", "lien", "facility", "tranche_text", "industry", "country", "currency", "reference_rate")


def finalize(positions: DataFrame) -> DataFrame:
    """Fills what the label tells and the filing didn't tag; adds issuer_id, loan_id, credit_id and is_debt."""
    out = positions
    for name in TEXTS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    for name, kind in (("is_non_accrual", "boolean"), ("maturity_date", "date")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    out = out.withColumn("_split", identity.split_identifier(F.col("identifier")))
    out = out.withColumns({"issuer_name": F.coalesce(blank("issuer_name"), F.col("_split.issuer")), "tranche_text": F.coalesce(blank("tranche_text"), F.col("_split.rest"))})
    label = coerce.joined(F.col("tranche_text"), F.col("identifier"))
    out = out.withColumn("_class", identity.classified(F.col("investment_type"), F.col("lien"), F.col("tranche_text"), F.col("identifier"), F.col("industry")))
    known = F.col("investment_type").isin([t for t, *_ in identity.TYPES])
    out = out.withColumns(
        {
            "investment_type": F.when(known, F.col("investment_type")).otherwise(F.col("_class.type")),
            "lien": F.coalesce(F.when(known, blank("lien")), F.col("_class.lien")),
            "facility": F.coalesce(blank("facility"), identity.facility(label)),
            "currency": F.coalesce(blank("currency"), coerce.currency(label)),
            "reference_rate": F.coalesce(blank("reference_rate"), coerce.reference_rate(label)),
            "is_non_accrual": F.coalesce("is_non_accrual", coerce.non_accrual(label)),
            "maturity_date": F.coalesce("maturity_date", coerce.maturity_in_label(label)),
            "country": coerce.country(F.col("country")),
        }
    )
    out = out.withColumns({"_canonical": identity.canonical_issuer(F.col("issuer_name")), "_tranche": identity.tranche(F.col("tranche_text"))})
    return out.withColumns(
        {
            "is_debt": identity.is_debt(F.col("investment_type")),
            "issuer_id": identity.digest("issuer", F.col("_canonical")),
            "loan_id": identity.loan_digest(F.col("cik"), F.col("_canonical"), F.col("investment_type"), F.col("_tranche"), F.col("currency")),
            "credit_id": identity.credit_digest(F.col("_canonical"), F.col("investment_type")),
        }
    ).drop("_split", "_class", "_canonical", "_tranche")
