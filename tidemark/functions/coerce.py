"""Filed text to amounts, dates, rates and names, as Column expressions.

Null and unreadable input gives null throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(24,4)"

# What filings write.
BLANKS = ["", "nan", "none", "null", "-", "—"]
DAY_FORMATS = ["yyyy-M-d", "M/d/yyyy", "M/d/yy", "yyyyMMdd", "d-MMM-yyyy", "MMM d, yyyy"]
MONTH_FORMATS = ["M/yyyy", "M-yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-M"]
LABEL_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "MMMM yyyy", "MMM yyyy"]
REFERENCE_RATES = [
    ("TERM SOFR", r"term\s*sofr"),
    ("SOFR", r"\bsofr\b"),
    ("LIBOR", r"\blibor\b|\bl\s*\+"),
    ("EURIBOR", r"\beuribor\b"),
    ("SONIA", r"\bsonia\b"),
    ("PRIME", r"\bprime\b|\bp\s*\+"),
    ("BASE", r"\bbase\s*rate\b"),
]
CURRENCIES = [
    ("EUR", r"\beur\b|€"),
    ("GBP", r"\bgbp\b|£"),
    ("CAD", r"\bcad\b"),
    ("AUD", r"\baud\b"),
    ("SEK", r"\bsek\b"),
    ("DKK", r"\bdkk\b"),
    ("NOK", r"\bnok\b"),
    ("CHF", r"\bchf\b"),
]
# Fixed value: wording of filings.
NON_ACCRUAL = r"non[\s-]*accrual|nonaccrual"
# Fixed value: wording of filings.
MATURITY_IN_LABEL = (
    r"\b(?:due|matur(?:es|ity|ing))\b[\s:,-]{0,6}"
    r"(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}|[A-Za-z]{3,9}\.?\s+\d{4})"
)
# Fixed value: wording of filings.
NOT_A_PLACE = r"affiliat|control|majority[\s-]*owned|non[\s-]*controlled|portfolio compan"
# Countries by the ways that filings write them.
COUNTRIES = {
    "United States": ["US", "USA", "U.S.", "UNITED STATES OF AMERICA", "UNITED STATES"],
    "United Kingdom": ["UK", "U.K.", "GREAT BRITAIN", "UNITED KINGDOM"],
    "Canada": ["CA", "CANADA"],
    "Australia": ["AU", "AUSTRALIA"],
    "Germany": ["DE", "GERMANY"],
    "France": ["FR", "FRANCE"],
    "Netherlands": ["NL", "NETHERLANDS"],
    "Ireland": ["IE", "IRELAND"],
    "Luxembourg": ["LU", "LUXEMBOURG"],
    "Switzerland": ["CH", "SWITZERLAND"],
    "Sweden": ["SE", "SWEDEN"],
    "Spain": ["ES", "SPAIN"],
    "Italy": ["IT", "ITALY"],
    "New Zealand": ["NZ", "NEW ZEALAND"],
    "Singapore": ["SG", "SINGAPORE"],
    "India": ["IN", "INDIA"],
    "Israel": ["IL", "ISRAEL"],
    "Bermuda": ["BM", "BERMUDA"],
    "Cayman Islands": ["KY", "CAYMAN ISLANDS"],
}


def like(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode classes."""
    return text.rlike(f"(?iU){pattern}")


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null where there is none."""
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern is found."""
    return F.coalesce(*(F.when(like(text, pattern), F.lit(name)) for name, pattern in rules))


def _bare(text: Column) -> tuple[Column, Column]:
    """A figure without signs of money and brackets, and whether it is to be read as minus that figure."""
    clean = stripped(text)
    bare = stripped(F.regexp_replace(F.regexp_replace(clean, r"^[()]+|[()]+$", ""), "[$,%]", ""))
    return F.when(~F.lower(clean).isin(BLANKS), bare), clean.rlike(r"(?s)^\(.*\)$")


def to_decimal(text: Column) -> Column:
    """An amount with four places: "$1,234.5", "(500)" for minus 500; a percent sign is dropped, not applied.

    Null above twenty whole digits.
    """
    bare, minus = _bare(text)
    amount = bare.try_cast(MONEY)
    return F.when(minus, -amount).otherwise(amount)


def to_float(text: Column) -> Column:
    """A figure with all its digits, read as an amount is."""
    bare, minus = _bare(text)
    value = F.when(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    return F.when(minus, -value).otherwise(value)


def _parsed(text: Column, formats: list[str]) -> Column:
    # Two-digit years pivot at 69, as C's strptime does.
    def one(fmt: str) -> Column:
        day = F.try_to_date(text, fmt)
        two = fmt == "M/d/yy"
        return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)) if two else day

    return F.coalesce(*map(one, formats))


def to_date(text: Column) -> Column:
    """A day, or the first of a month where only the month is written."""
    clean = stripped(text)
    return _parsed(clean, DAY_FORMATS + MONTH_FORMATS)


def to_rate_pct(text: Column) -> Column:
    """A rate in percentage points; values up to 1.5 are fractions."""
    value = to_float(text)
    return F.when(F.abs(value) <= 1.5, value * 100).otherwise(value)


def reference_rate(text: Column) -> Column:
    return first_rule(text, REFERENCE_RATES)


def currency(text: Column) -> Column:
    return F.coalesce(first_rule(text, CURRENCIES), F.lit("USD"))


def non_accrual(text: Column) -> Column:
    """True or null: a label never says that a loan accrues."""
    return F.when(like(text, NON_ACCRUAL), F.lit(True))


def maturity_in_label(text: Column) -> Column:
    written = F.regexp_replace(stripped(extract(text, MATURITY_IN_LABEL)), ",$", "")
    plain = F.regexp_replace(F.regexp_replace(written, r"\.", ""), r"(?U)\s+", " ")
    return F.coalesce(to_date(written), _parsed(plain, LABEL_FORMATS))


def country(text: Column) -> Column:
    """A tagged place in its usual name; affiliations aren't places, other text stays as it is."""
    clean = stripped(text)
    member = extract(clean, r"^https?://\S+?#(\w+)$")
    words = F.coalesce(F.regexp_replace(member, "(?<=[a-z])(?=[A-Z])", " "), clean)
    words = F.regexp_replace(words, r"(?i)\[member\]|member$", "")
    words = F.regexp_replace(F.regexp_replace(words, r"(?U)\s+", " "), r"^[ .,]+|[ .,]+$", "")
    names = F.create_map(*(F.lit(x) for name, aliases in COUNTRIES.items() for alias in aliases for x in (alias.strip("."), name)))
    known = F.coalesce(F.try_element_at(names, F.upper(words)), words)
    return F.when((words != "") & ~like(words, NOT_A_PLACE), known)


def joined(*texts: Column) -> Column:
    """Texts that aren't empty, with a blank between."""
    return F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in texts))


def flags(*rules: tuple[Column, Column | str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, name if isinstance(name, Column) else F.lit(name)) for rule, name in rules)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
