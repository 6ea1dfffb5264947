"""Printed schedules of investments in filings' HTML, and the positions that they complete.

Python reads a document's tables into texts of fields, one document at a time; dates, figures, names and all matching are
Column expressions and joins.  Rows and positions meet by borrower and by size of their fair values (:func:`candidates`), and are paired
one to one in rounds of mutual nearest (:func:`closest_first`), so a borrower with very many rows is no group of its own.

A document without a schedule gives no row; a null document is an empty one.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import coerce, identity
from tidemark.storage import shared_path

# What a column is for; the first pattern that finds a free column claims it.
COLUMNS = [
    ("acquisition", r"acquisition\s*date|date\s*acquired|initial\s*acquisition"),
    ("maturity", r"maturity|due\s*date"),
    ("industry", r"industry|sector"),
    ("country", r"country|geograph|domicile"),
    ("fair_value", r"fair\s*value"),
    ("cost", r"\bcost\b|amortized\s*cost"),
    ("principal", r"principal|\bpar\b|face\s*amount"),
    ("instrument", r"investment\s*type|type\s*of\s*investment|security|instrument"),
    ("issuer", r"portfolio\s*compan|company|issuer|investment(?!\s*type)"),
]
# Fixed value: what printed schedules write.
TOTAL = re.compile(r"^\s*(sub)?total|^\s*net\s|aggregate", re.I)
# Fixed value: what printed schedules write.
NUMBER = re.compile(r"^\(?\s*[$€£]?\s*[\d,]+(\.\d+)?\s*\)?$")
FIGURES = ("fair_value", "cost", "principal")
DESCRIPTIONS = ("instrument", "maturity", "acquisition", "industry")
SCALES = (1.0, 1e3, 1e6)
NEAR, HEADER_ROWS, MIN_ROWS, LONGEST_HEADING = 4, 6, 3, 90
TEXTS = ["issuer", "industry", "country", "maturity", "acquisition", "instrument", *FIGURES]
DDL = "accession string, seq long, " + ", ".join(f"{t} string" for t in TEXTS)


class _Tables(HTMLParser):
    """Tables of a document as rows of (text, width, is heading); a nested table is one of its own."""

    def __init__(self):
        super().__init__()
        self.tables, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and self.open[-1] and tag in ("td", "th"):
            span = dict(attrs).get("colspan") or "1"
            self.open[-1][-1].append(["", min(int(span), 1000) if span.isdigit() and int(span) else 1, tag == "th"])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1][0] += data


def spread(row: list, repeat: bool) -> dict[int, str]:
    """Column -> text of a row's cells; a wide cell's text at its first column, or at each of them."""
    found, at = {}, 0
    for text, width, _ in row:
        if text := " ".join(text.split()):
            found |= dict.fromkeys(range(at, at + (width if repeat else 1)), text)
        at += width
    return found


def columns_of(rows: list) -> dict[str, int]:
    """Field -> column, of header rows taken together."""
    heads: dict[int, str] = {}
    for row in rows:
        for at, text in spread(row, repeat=True).items():
            heads[at] = f"{heads[at]} {text}" if at in heads else text
    found: dict[str, int] = {}
    for field, pattern in COLUMNS:
        at = next((a for a in sorted(heads) if a not in found.values() and re.search(pattern, heads[a], re.I)), None)
        if at is not None:
            found[field] = at
    return found


def is_schedule(columns: dict[str, int]) -> bool:
    has = columns.keys()
    return {"issuer", "fair_value"} <= has and bool({"cost", "principal"} & has) and bool(set(DESCRIPTIONS) & has)


def header_of(table: list) -> tuple[dict[str, int], int]:
    """Columns and the number of header rows: the marked ones, else the fewest leading rows whose last ones make a header."""
    marked = next((i for i, row in enumerate(table) if not row or not all(c[2] for c in row)), len(table))
    if marked and is_schedule(columns := columns_of(table[:marked])):
        return columns, marked
    for end in range(1, min(HEADER_ROWS, len(table)) + 1):
        usable = [c for start in range(end) if is_schedule(c := columns_of(table[start:end]))]
        if usable:
            return max(usable, key=len), end
    return {}, 0


def is_borrower(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    ascii_letters = re.sub("[^A-Za-z]", "", text)
    return len(letters) >= 3 and not NUMBER.match(text) and not TOTAL.match(text) and not (ascii_letters.isupper() and len(ascii_letters) > 4)


def rows_of(table: list, columns: dict[str, int], skip: int) -> list[dict[str, str | None]]:
    """Priced rows of a table; a lone text is the industry of the rows below it.  Fewer than three rows are no schedule."""
    out, section = [], None
    for row in table[skip:]:
        cells = spread(row, repeat=False)
        if len(cells) == 1:
            (lone,) = cells.values()
            name = re.sub(r"^\s*(industry|sector)\s*[:\-—]\s*", "", lone, flags=re.I).strip(" :–—-")
            if name and len(lone) <= LONGEST_HEADING and not NUMBER.match(lone) and not TOTAL.match(lone):
                section = name
            continue

        def value(field: str, cells=cells) -> str | None:
            at = columns.get(field)
            near = [] if at is None else [t for i in range(at, at + NEAR) if (t := cells.get(i)) and t not in ("$", "€", "£")]
            return next((t for t in near if field not in FIGURES or NUMBER.match(t)), None)

        found = {field: value(field) for field in TEXTS}
        if found["issuer"] and is_borrower(found["issuer"]) and any(found[f] for f in FIGURES):
            out.append(found | {"industry": found["industry"] or section, "instrument": found["instrument"] or found["issuer"]})
    return out if len(out) >= MIN_ROWS else []


def schedule_of(html: str) -> list[dict[str, str | None]]:
    """All rows of a document; a table without a header goes on with the last one if half its rows describe a holding, in words
    or dates."""
    reader = _Tables()
    reader.feed(html)
    out, carried = [], None
    for table in reader.tables:
        columns, skip = header_of(table)
        if columns:
            carried = columns
            out += rows_of(table, columns, skip)
        elif carried:
            rows = rows_of(table, carried, 0)
            told = [d for d in DESCRIPTIONS if d in carried]
            described = sum(any(r[d] and not NUMBER.match(r[d]) and (d != "instrument" or r[d] != r["issuer"]) for d in told) for r in rows)
            out += rows if 2 * described >= len(rows) else []
    return out


def _figure(text: Column) -> tuple[Column, Column]:
    """A printed figure and the unit of its last digit."""
    bare = F.regexp_replace(text, r"[,$€£()\s]", "")
    number = bare.try_cast("double")
    return F.when(text.startswith("("), -number).otherwise(number), F.pow(F.lit(10.0), -F.length(F.regexp_extract(bare, r"\.(\d+)$", 1)))


def read_schedules(filings: DataFrame) -> DataFrame:
    """(accession, html) -> printed rows: issuer_id, industry, country, dates, instrument, figures with their steps."""

    def run(batches):
        for batch in batches:
            for accession, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = schedule_of(html or "")
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([accession] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array([r[t] for r in rows], pa.string()) for t in TEXTS)],
                        names=["accession", "seq", *TEXTS],
                    )

    return printed_rows(filings.select("accession", "html").mapInArrow(run, DDL))


def printed_rows(raw: DataFrame) -> DataFrame:
    """Texts of a document's fields (columns of ``DDL``) -> rows with dates, figures and keys."""
    figures = {}
    for c in FIGURES:
        figures[c], figures[f"{c}_step"] = _figure(F.col(c))
    return raw.select(
        "accession",
        F.col("seq").alias("row"),
        "issuer",
        identity.issuer_key(F.col("issuer")).alias("issuer_id"),
        "industry",
        coerce.country(F.col("country")).alias("country"),
        F.coalesce(coerce.to_date(F.col("maturity")), coerce.maturity_in_label(F.col("maturity"))).alias("maturity_date"),
        coerce.to_date(F.col("acquisition")).alias("acquisition_date"),
        "instrument",
        *(v.alias(k) for k, v in figures.items()),
    )


#: Classes of printed fair values: the least count of steps of such a value, and the width of its buckets in natural logarithms.  Half a step and a
#: thousandth of the tagged value are then less than a bucket: ln 2 < 0.7 for any value of a step and more, and ln(1 + 1/199) < 0.006 for
#: values of a hundred steps.
BANDS = ((100.0, 0.006), (1.0, 0.7))


def _bucket(value: Column, width: float) -> Column:
    return F.floor(F.ln(value) / width)


def compared(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of priced positions and printed rows of one borrower and filing whose fair values are of one size at a scale.

    A row looks into its value's bucket and both beside it, a position lies in one bucket of each class, so a pair meets once for
    each scale.  Rows of value zero meet positions within half their step, by borrower alone; they are few.

    Here and in the other joins of whole filings both sides are sent (``merge``): the optimizer takes staged files by their size, which is that of
    compressed rows ahead of any explode, and would send millions of rows through the driver.
    """
    p = positions.where("fair_value > 0").select("accession", "issuer_id", "seq", *(F.col(c).cast("double").alias(f"t_{c}") for c in FIGURES))
    scaled = rows.where("fair_value >= 0").withColumn("dates", F.struct("maturity_date", "acquisition_date")).withColumn("scale", F.explode(F.array(*map(F.lit, SCALES))))
    value, steps = F.col("fair_value") * F.col("scale"), F.col("fair_value") / F.col("fair_value_step")
    band = F.coalesce(*(F.when(steps >= least, i) for i, (least, _) in enumerate(BANDS)))
    bucket = F.coalesce(*(F.when(F.col("band") == i, _bucket(value, width)) for i, (_, width) in enumerate(BANDS)))
    r = scaled.withColumn("band", band).where("band IS NOT NULL").withColumn("bucket", bucket)
    r = r.withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("bucket") + d)))
    places = F.array(*(F.struct(F.lit(i).alias("band"), _bucket(F.col("t_fair_value"), width).alias("bucket")) for i, (_, width) in enumerate(BANDS)))
    met = p.select("*", F.inline(places)).join(r.hint("merge"), ["accession", "issuer_id", "band", "bucket"]).drop("band", "bucket")
    nil = scaled.where(F.col("fair_value") < F.col("fair_value_step"))
    return met.unionByName(p.join(nil.hint("merge"), ["accession", "issuer_id"]).where(F.col("t_fair_value") <= 0.5 * F.col("fair_value_step") * F.col("scale")))


def candidates(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """(accession, issuer_id, scale, seq, row, gap, dates): rows whose every figure could be the position's, at each scale.

    A printed figure stands for half a step on either side, and for a thousandth of the tagged one at least; where either
    is missing they don't disagree.
    """
    near = F.lit(True)
    for c in FIGURES:
        gap = F.abs(F.col(c) * F.col("scale") - F.col(f"t_{c}"))
        near &= F.coalesce(gap <= F.greatest(0.5 * F.col(f"{c}_step") * F.col("scale"), F.abs(F.col(f"t_{c}")) * 0.001), F.lit(True))
    return compared(positions, rows).where(near).select("accession", "issuer_id", "scale", "seq", "row", F.abs(F.col("fair_value") * F.col("scale") - F.col("t_fair_value")).alias("gap"), "dates")


def closest_first(pairs: DataFrame) -> DataFrame:
    """Of pairs (accession, issuer_id, scale, seq, row, gap) the ones that a greedy choice takes, closest first by (gap, row, seq).

    A pair that is the closest both of its row's and of its position's is taken by the greedy choice, whatever else there is, since only
    pairs with that row or position could keep it out.  So each round takes all such pairs and drops those that share a row or a
    position with them, until none is left; every round takes the closest of all, so it ends.  Each round is stored.
    """
    spark, group = pairs.sparkSession, ("accession", "issuer_id", "scale")
    order = F.struct("gap", "row", "seq")

    def kept(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "pairs")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    taken, left = None, pairs.select(*group, "seq", "row", "gap")
    while True:
        of_row, of_seq = Window.partitionBy(*group, "row"), Window.partitionBy(*group, "seq")
        ranked = left.withColumn("_order", order).withColumn("_mutual", F.min("_order").over(of_row) == F.col("_order"))
        ranked = ranked.withColumn("_mutual", F.col("_mutual") & (F.min("_order").over(of_seq) == F.col("_order"))).drop("_order")
        gone = F.max("_mutual").over(of_seq) | F.max("_mutual").over(of_row)
        stage = kept(ranked.withColumn("_gone", gone))
        found = stage.where("_mutual").select(*group, "seq", "row")
        taken = found if taken is None else taken.unionByName(found)
        left = stage.where("NOT _gone").select(*group, "seq", "row", "gap")
        if left.isEmpty():
            return taken


def matches(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """(accession, issuer_id, scale, seq, row): one row for a position, at the filing's best scale, closest first.

    A position whose candidates have different dates gets none.  The scale that matches most is the filing's; the
    smaller of two.
    """
    own = Window.partitionBy("accession", "issuer_id", "scale", "seq")
    agreed = candidates(positions, rows).withColumns({"a": F.min("dates").over(own), "b": F.max("dates").over(own)}).where("a <=> b").drop("a", "b", "dates")
    pairs = closest_first(agreed)
    best = pairs.groupBy("accession", "scale").count().groupBy("accession").agg(F.max_by("scale", F.struct("count", -F.col("scale"))).alias("scale"))
    return pairs.join(best, ["accession", "scale"], "left_semi")


def enrich(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """Fills blanks alone: industry and country by borrower, dates by matched row, years where all a borrower's rows agree."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row"))).alias(f"_{c}")
    year = lambda c, name: F.when(F.count_distinct(F.year(c)) == 1, F.min(F.year(c))).alias(name)
    borrowers = rows.groupBy("accession", "issuer_id").agg(first("industry"), first("country"), year("acquisition_date", "_acquired"), year("maturity_date", "_matures"))
    printed = rows.select("accession", "row", F.col("maturity_date").alias("_m"), F.col("acquisition_date").alias("_a"))
    dated = matches(positions, rows).join(printed.hint("merge"), ["accession", "row"]).select("accession", "seq", "_m", "_a")
    out = positions.join(borrowers.hint("merge"), ["accession", "issuer_id"], "left").join(dated.hint("merge"), ["accession", "seq"], "left")
    dates = {"maturity_date": F.coalesce("maturity_date", "_m"), "acquisition_date": F.coalesce("acquisition_date", "_a")}
    filled = {"industry": F.coalesce("industry", "_industry"), "country": F.coalesce("country", "_country")} | dates
    filled["year_acquired"] = F.coalesce("year_acquired", F.when(dates["acquisition_date"].isNull(), F.col("_acquired")))
    filled["year_matures"] = F.coalesce("year_matures", F.when(dates["maturity_date"].isNull(), F.col("_matures")))
    touched = F.lit(False)
    for c, value in filled.items():
        touched |= F.col(c).isNull() & value.isNotNull()
    filled["flags"] = F.when(touched, F.concat("flags", F.array(F.lit("enriched_from_schedule")))).otherwise(F.col("flags"))
    return out.withColumns(filled).select(*positions.columns)


def match_report(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """Positions of each filing by outcome."""
    scale = matches(positions, rows).select("accession", "scale", "seq")
    best = scale.select("accession", "scale").distinct()
    reached = candidates(positions, rows).join(best, ["accession", "scale"], "left_semi").select("accession", "seq").distinct()
    tagged = (
        positions.select("accession", "issuer_id", "seq", "fair_value")
        .join(rows.select("accession", "issuer_id").distinct().withColumn("printed", F.lit(True)).hint("merge"), ["accession", "issuer_id"], "left")
        .join(best.select("accession").withColumn("scaled", F.lit(True)), "accession", "left")
        .join(scale.select("accession", "seq").withColumn("matched", F.lit(True)).hint("merge"), ["accession", "seq"], "left")
        .join(reached.withColumn("reached", F.lit(True)).hint("merge"), ["accession", "seq"], "left")
    )
    outcome = (
        F.when(F.col("scaled").isNull() | F.col("printed").isNull(), "borrower_not_in_schedule")
        .when(F.col("fair_value").isNull(), "position_unpriced")
        .when(F.col("matched"), "matched")
        .when(F.col("reached"), "ambiguous")
        .otherwise("no_row_within_reach")
    )
    return tagged.groupBy("accession", outcome.alias("outcome")).agg(F.count("*").alias("positions"))


def schedule_coverage(rows: DataFrame) -> DataFrame:
    """Share of a filing's printed rows that have each attribute."""
    share = lambda c: F.round(F.count(c) / F.count("*"), 6).alias(c)
    return rows.groupBy("accession").agg(F.count("*").alias("rows"), *map(share, ("industry", "country", "maturity_date", "acquisition_date", *FIGURES)))
