"""Queries that show how data comes in: drifting headings, whole filings and their faults, loads and their log, coverage, the universe, row
blocks; each with its SQL.  All work on rows of the test tables, written out in the form that is read."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import blocks, coverage, store, views
from tidemark.plans.oracle import FX, MARKS, QUARTER, RAW, day
from tidemark.sources import filings, lens, schedules, tables, universe
from tidemark.streaming import corrections
from tidemark.storage import shared_path

WINDOW = ("1996Q1", "2001-Q4")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def landing_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in one landing folder as three releases: cost behind fair value, before it under other headings, and with a heading nobody knows."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    fair, cost = text(F.col("p_retailprice").cast("decimal(12,2)")), text((F.col("p_retailprice") / 2).cast("decimal(12,2)"))
    plain = [F.concat(F.lit("r"), k % 3).alias("adsh"), text(k % 5).alias("cik"), F.lit("20010930").alias("ddate")]
    label = F.concat(F.lit("Maker "), k, F.lit(" LLC, Second Lien Term Loan [Member]")).alias("Investment, Identifier Axis")
    releases = [
        [*plain, label, fair.alias("Investment Owned, Fair Value"), cost.alias("Investment Owned, Cost")],
        [cost.alias("Investment Owned, at Cost"), label, F.lit("2").alias("Fair Value Hierarchy Level"), fair.alias("Investment Owned, at Fair Value"), *plain],
        [label, F.lit("DE").alias("Country Axis"), *plain[::-1], fair.alias("Holdings, fair value reported"), cost.alias("Amortized cost of holdings")],
    ]
    landing = shared_path(spark, "landing")
    for i, columns in enumerate(releases):
        _read(spark, sf_dir, "part").where(k % 3 == i).select(*columns).write.csv(f"{landing}/release-{i}", sep="\t", header=True, quote="")
    rows = tables.landing_positions(spark, landing, ciks=[1, 2, 3, 4])
    return rows.select("accession", "cik", "issuer_name", "country", *(views.money(F.col(c)).alias(c) for c in ("fair_value", "cost")), "loan_id")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fifty filings: facts as JSON and a printed page.  Filing 7's JSON is cut off, filing 11 has none, a fact of filing 17 has no
    concept, and a width on the page of filing 13 isn't a number."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 50
    fact = lambda concept, value: F.struct(F.lit(f"us-gaap:{concept}").alias("concept"), F.lit("instant").alias("period_type"), F.lit("2001-09-30").alias("period_instant"), value.alias("numeric_value"), F.create_map(F.lit("us-gaap_InvestmentIdentifierAxis"), F.concat(F.lit("Maker "), k, F.lit(" LLC, First Lien Term Loan"))).alias("dims"))
    facts = F.concat_ws(",", F.to_json(fact("InvestmentOwnedAtFairValue", F.col("p_retailprice") * 1000)), F.to_json(fact("InvestmentOwnedBalancePrincipalAmount", F.col("p_retailprice") * 2000)))
    td = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    line = td(F.concat(F.lit("Maker "), k, F.lit(" LLC")), F.lit("First Lien Term Loan"), F.concat(F.col("p_size") % 12 + 1, F.lit("/15/1999")), F.lit("6/30/2029"), F.format_number(F.col("p_retailprice") * 2, 2), F.format_number("p_retailprice", 2))
    own = _read(spark, sf_dir, "part").select(n.alias("n"), k.alias("k"), facts.alias("facts"), line.alias("line"))
    rows = own.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("k", "facts", "line"))).alias("x"))
    json = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["facts"]), ","), F.lit("]"))
    width = F.when(F.col("n") == 13, "²").otherwise("1")
    head = F.concat(F.lit('<table><tr><th colspan="'), width, F.lit('">Company</th>'), F.lit("".join(f"<th>{x}</th>" for x in ("Security", "Date Acquired", "Maturity", "Principal", "Fair Value"))), F.lit("</tr><tr><td>Industry: Timber</td></tr>"))
    facts = F.when(F.col("n") == 7, F.substring(json, 1, 40)).when(F.col("n") == 17, F.replace(json, F.lit('"concept"'), F.lit('"name"'))).when(F.col("n") != 11, json)
    page = F.concat(head, F.array_join(F.transform("x", lambda x: x["line"]), ""), F.lit("</table>"))
    return rows.select(F.concat(F.lit("s"), "n").alias("accession"), F.col("n").cast("long").alias("cik"), F.lit("10-Q").alias("form"), F.lit("2001-11-15").cast("date").alias("filed_date"), facts.alias("facts"), page.alias("html"))


def filing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filing with what was read of it, and the fault where there was one."""
    all_of = _filings(spark, sf_dir)
    read = filings.read_filings(all_of)
    of = lambda df, name: df.groupBy("accession").agg(F.count("*").alias(name))
    rows = all_of.select("accession").join(of(read.facts, "facts"), "accession", "left").join(of(read.printed, "printed"), "accession", "left").join(read.errors, "accession", "left")
    return rows.select("accession", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("facts", "printed")), "part", "cause")


def filing_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all filings that could be read, with dates from their pages."""
    names = spark.range(50).select(F.col("id").alias("cik"), F.concat(F.lit("H"), "id").alias("ticker"), F.concat(F.lit("Holder "), "id").alias("bdc_name"))
    rows, _ = filings.harvest(_filings(spark, sf_dir), names)
    return rows.select("accession", "cik", "ticker", "identifier", views.money(F.col("fair_value")).alias("fair_value"), "industry", _day("acquisition_date"), _day("maturity_date"), F.array_join("flags", ",").alias("flags"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one store, each source's filings, and the marks that the second snapshot has of each period."""
    root = shared_path(spark, "store")
    for source in ("dera", "xbrl"):
        found = store.load_merged(spark, root, lens.merged(spark, sf_dir, source), lens.rates(spark, sf_dir), new=source == "dera", source=source, scope="lens")
    log = store.run_log(spark, root).select("snapshot", "source", "scope", "rows", "periods")
    marks = found.marks.agg(F.count("*").alias("marks_after"))
    return log.join(marks.withColumn("snapshot", F.lit(2).cast("long")), "snapshot", "left")


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Filers, of which every third had no bulk load, and loaded periods, where every third lost a quarter a year from 1999 on."""
    f = store.lens_frames(spark, sf_dir)
    lost = (F.col("cik") % 3 == 0) & (F.year("period_end") >= 1999) & (F.quarter("period_end") == F.col("cik") % 4 + 1)
    marks = f.marks.where(~lost).select("cik", "period_end", views.quarter_label("period_end").alias("quarter")).distinct()
    return f.bdcs.select("cik", (F.col("cik") % 3 != 2).alias("bulk_ran")), marks


def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    filers, marks = _loaded(spark, sf_dir)
    return coverage.coverage_islands(coverage.quarter_states(filers, marks, *WINDOW)).select("cik", F.col("loaded").cast("int").alias("loaded"), "first_quarter", "last_quarter", "quarters")


def fallback_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.fallback_since(*_loaded(spark, sf_dir), *WINDOW)
    return rows.select("cik", _day("since"), "cause")


def universe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as filers, every tenth on the watch-list; some without a number, renamed, off the official list or out of the ticker file."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    supplier = _read(spark, sf_dir, "supplier")
    ticker = F.concat(F.lit("S"), k)
    entries = supplier.select(
        F.when(k % 10 == 0, "watchlist").otherwise("bdcs").alias("list"), ticker.alias("ticker"), F.when((k % 6 != 0) & (k % 20 != 0), k.cast("long")).alias("cik"), F.when(k % 4 == 1, F.concat(F.lit("Old "), name)).otherwise(name).alias("name")
    )
    official = supplier.where(k % 7 != 3).select(k.cast("long").alias("cik"))
    listed = supplier.where(k % 9 != 0).select(ticker.alias("ticker"), k.cast("long").alias("cik"), name.alias("name"))
    second = supplier.where(k % 5 == 1).select(F.concat(ticker, F.lit("W")), k.cast("long"), F.concat(name, F.lit(" Warrants")))
    return universe.universe_check(entries, official, listed.union(second))


def period_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.period_blocks(views.marks_export(store.lens_frames(spark, sf_dir)))


def published_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the newest quarter that was published on their day."""
    orders = _read(spark, sf_dir, "orders").select(tables.latest_published_quarter(F.to_date("o_orderdate")).alias("quarter"))
    return orders.groupBy("quarter").agg(F.count("*").alias("orders"))


def late_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as filed, then every third with another value and some new ones, each as files that a stream finds."""
    k, landing, root, seen = F.col("p_partkey"), shared_path(spark, "landing"), shared_path(spark, "store"), shared_path(spark, "seen")
    names = spark.range(3).select(F.col("id").alias("cik"), F.concat(F.lit("C"), "id").alias("ticker"), F.concat(F.lit("Holder "), "id").alias("bdc_name"))
    part = _read(spark, sf_dir, "part")

    def release(rows: DataFrame, value: Column, name: str) -> None:
        label = F.concat(F.lit("Maker "), k, F.lit(" LLC, Second Lien Term Loan")).alias("Investment, Identifier Axis")
        columns = [F.lit(name).alias("adsh"), (k % 3).cast("string").alias("cik"), F.lit("20010930").alias("ddate"), label, value.cast("decimal(12,2)").cast("string").alias("Investment Owned, Fair Value"), F.lit("100").alias("Investment Owned, Balance, Principal Amount")]
        rows.select(*(columns if name == "first" else columns[::-1])).write.csv(f"{landing}/{name}", sep="\t", header=True, quote="")

    for rows, value, name in ((part.where(k % 7 != 0), F.col("p_retailprice"), "first"), (part.where(k % 7 <= 2), F.col("p_retailprice") + 1, "second")):
        release(rows, value, name)
        corrections.corrections(spark, landing, root, names, lens.rates(spark, sf_dir), seen).awaitTermination()
    found = store.open_store(spark, root)
    return found.v_marks.select("issuer_name", "cik", "accession", views.money(F.col("fair_value")).alias("fair_value"), F.round("mark", 6).alias("mark"))


def raw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filed rows by loan key, ahead of merging."""
    rows = views.raw_groups(lens.positions(spark, sf_dir))
    filed = F.transform("filed", lambda x: F.concat_ws("/", x["period_end"], x["accession"], x["seq"].cast("string")))
    return rows.select("loan_id", "investment_type", "facility", "raw_rows", F.sha2(F.array_join(filed, ",").cast("binary"), 256).alias("filed_sha256"), F.aggregate("filed", F.lit(0.0), lambda a, x: a + F.coalesce(x["principal"], F.lit(0.0)), lambda a: F.round(a, 2)).alias("principal"))


def schedule_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts printed in three layouts, a filing each for ten of them: headings stacked over wide cells, headings in ordinary rows with the currency in a
    cell of its own, and a table whose second half goes on under no heading."""
    k, layout = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10) % 3
    cells = lambda tag, *texts: F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), t if isinstance(t, Column) else F.lit(t), F.lit(f"</{tag}>")) for t in texts), F.lit("</tr>"))
    name, bond, due, figure = F.concat(F.lit("Maker "), k, F.lit(" LLC")), F.lit("Term Loan"), F.lit("6/30/2029"), F.format_number("p_retailprice", 2)
    line = F.when(layout == 1, cells("td", name, bond, due, "$", figure, "$", figure)).otherwise(cells("td", name, bond, due, figure, figure))
    own = _read(spark, sf_dir, "part").select(F.floor(k / 10).alias("n"), layout.alias("layout"), k.alias("k"), line.alias("line"))
    rows = own.groupBy("n", "layout").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    stacked = '<table><tr><th>Portfolio</th><th>Investment</th><th>Maturity</th><th colspan="2">Amortized</th></tr><tr><th>Company</th><th>Type</th><th>Date</th><th>Cost</th><th>Fair Value</th></tr>'
    plain = '<table><tr><td>Company</td><td>Security</td><td>Maturity</td><td colspan="2">Cost</td><td colspan="2">Fair Value</td></tr>'
    marked = "<table><tr><th>Company</th><th>Security</th><th>Maturity</th><th>Cost</th><th>Fair Value</th></tr>"
    half = F.floor(F.size("lines") / 2).cast("int")
    text = lambda lines: F.array_join(lines, "")
    body = F.when(F.col("layout") == 2, F.concat(text(F.slice("lines", F.lit(1), half)), F.lit("</table><p>continued</p><table>"), text(F.slice("lines", half + 1, F.size("lines"))))).otherwise(text(F.col("lines")))
    html = F.concat(F.when(F.col("layout") == 0, stacked).when(F.col("layout") == 1, plain).otherwise(marked), body, F.lit("</table>"))
    read = schedules.read_schedules(rows.select(F.concat(F.lit("n"), "n").alias("accession"), html.alias("html")))
    return read.select("accession", "issuer", "instrument", _day("maturity_date"), "cost", "fair_value")


def unpriced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the export with and without unpriced ones, where every fifth filer hasn't priced anything."""
    f = store.lens_frames(spark, sf_dir)
    hidden = replace(f, marks=f.marks.withColumn("fair_value", F.when(F.col("cik") % 5 != 0, F.col("fair_value"))))
    rows = [views.marks_export(hidden, include_unpriced=shown).select("ticker", F.lit(int(shown)).alias("unpriced")) for shown in (False, True)]
    return rows[0].unionByName(rows[1]).groupBy("ticker").agg(F.count(F.when(F.col("unpriced") == 0, 1)).alias("priced"), F.count(F.when(F.col("unpriced") == 1, 1)).alias("all_rows"))


QUERIES = {f.__name__: f for f in (landing_drift, filing_errors, filing_harvest, run_log, coverage_islands, fallback_since, universe_check, period_blocks, published_quarters, late_corrections, raw_positions, schedule_layouts, unpriced_rows)}

_STATES = f"""{MARKS}, have AS (
  SELECT DISTINCT cik, period_end, {QUARTER} AS quarter FROM v WHERE NOT (cik % 3 = 0 AND year(period_end) >= 1999 AND quarter(period_end) = cik % 4 + 1)
), states AS (
  SELECT f.cik, q.quarter, EXISTS (SELECT 1 FROM have h WHERE h.cik = f.cik AND h.quarter = q.quarter) AS loaded
  FROM (SELECT DISTINCT cik FROM v) f, (SELECT year(d) || 'Q' || quarter(d) AS quarter FROM generate_series(DATE '1996-01-01', DATE '2001-10-01', INTERVAL 3 MONTH) g(d)) q
)"""

SQL = {
    "landing_drift": """
        SELECT 'r' || p_partkey % 3 AS accession, p_partkey % 5 AS cik, 'Maker ' || p_partkey || ' LLC' AS issuer_name, CASE WHEN p_partkey % 3 = 2 THEN 'Germany' END AS country,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS fair_value, CAST(CAST(p_retailprice / 2 AS DECIMAL(12,2)) AS DOUBLE) AS cost,
               substr(sha1('loan|' || p_partkey % 5 || '|MAKER ' || p_partkey || '|SECOND_LIEN|TERM_LOAN|USD'), 1, 20) AS loan_id
        FROM part WHERE p_partkey % 5 <> 0""",
    "filing_errors": """
        SELECT 's' || n AS accession, CASE WHEN n IN (7, 11, 17) THEN 0 ELSE 2 * count(*) END AS facts, CASE WHEN n IN (7, 11, 17, 13) OR count(*) < 3 THEN 0 ELSE count(*) END AS printed,
               CASE WHEN n IN (7, 11, 17) THEN 'facts' WHEN n = 13 THEN 'page' END AS part,
               CASE n WHEN 7 THEN 'JSONDecodeError' WHEN 11 THEN 'NoFacts' WHEN 17 THEN 'KeyError' WHEN 13 THEN 'ValueError' END AS cause
        FROM (SELECT p_partkey % 50 AS n FROM part) GROUP BY n""",
    "filing_harvest": """
        SELECT 's' || p_partkey % 50 AS accession, p_partkey % 50 AS cik, 'H' || p_partkey % 50 AS ticker, 'Maker ' || p_partkey || ' LLC, First Lien Term Loan' AS identifier,
               CAST(CAST(p_retailprice * 1000 AS DECIMAL(24,4)) AS DOUBLE) AS fair_value, CASE WHEN p_partkey % 50 <> 13 THEN 'Timber' END AS industry,
               CASE WHEN p_partkey % 50 <> 13 THEN strftime(make_date(1999, p_size % 12 + 1, 15), '%Y-%m-%d') END AS acquisition_date,
               CASE WHEN p_partkey % 50 <> 13 THEN '2029-06-30' END AS maturity_date, CASE WHEN p_partkey % 50 <> 13 THEN 'enriched_from_schedule' ELSE '' END AS flags
        FROM part WHERE p_partkey % 50 NOT IN (7, 11, 17)""",
    "run_log": f"""{FX}, loads AS (SELECT l_linestatus, count(*) AS n, count(DISTINCT period_end) AS p FROM dollars GROUP BY 1)
        SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS snapshot, CASE WHEN l_linestatus = 'F' THEN 'dera' ELSE 'xbrl' END AS source, 'lens' AS scope, n AS rows, p AS periods,
               CASE WHEN l_linestatus <> 'F' THEN (SELECT count(*) FROM (SELECT DISTINCT loan_id, period_end FROM dollars)) END AS marks_after FROM loads""",
    "coverage_islands": f"""{_STATES}, runs AS (
          SELECT *, row_number() OVER (PARTITION BY cik ORDER BY quarter) - row_number() OVER (PARTITION BY cik, loaded ORDER BY quarter) AS run FROM states)
        SELECT cik, CAST(loaded AS INT) AS loaded, min(quarter) AS first_quarter, max(quarter) AS last_quarter, count(*) AS quarters FROM runs GROUP BY cik, loaded, run""",
    "fallback_since": f"""{_STATES}, gaps AS (SELECT cik, min(quarter) AS gap FROM states WHERE NOT loaded GROUP BY cik), newest AS (SELECT cik, max(period_end) AS newest FROM have GROUP BY cik)
        SELECT f.cik, strftime(CASE WHEN f.cik % 3 = 2 THEN DATE '1996-01-01' WHEN gap IS NOT NULL THEN make_date(CAST(gap[1:4] AS BIGINT), CAST(gap[6:6] AS BIGINT) * 3 - 2, 1) ELSE newest END, '%Y-%m-%d') AS since,
               CASE WHEN f.cik % 3 = 2 THEN 'no_bulk' WHEN gap IS NOT NULL THEN 'gap' ELSE 'newest' END AS cause
        FROM (SELECT DISTINCT cik FROM v) f LEFT JOIN gaps USING (cik) LEFT JOIN newest USING (cik)""",
    "universe_check": """
        WITH e AS (
          SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'watchlist' ELSE 'bdcs' END AS list, 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 20 <> 0 THEN s_suppkey END AS given,
                 CASE WHEN s_suppkey % 4 = 1 THEN 'Old ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey END AS found, s_suppkey % 7 <> 3 AS listed, s_name, s_suppkey FROM supplier
        ), r AS (
          SELECT *, CAST(coalesce(given, found) AS BIGINT) AS cik, CASE WHEN s_suppkey % 9 <> 0 THEN s_name WHEN s_suppkey % 5 = 1 THEN s_name || ' Warrants' END AS official_name FROM e
        ), o AS (
          SELECT *, 'resolved_by_ticker' AS outcome FROM r WHERE given IS NULL AND cik IS NOT NULL
          UNION ALL SELECT *, 'unresolved' FROM r WHERE cik IS NULL
          UNION ALL SELECT *, CASE WHEN listed THEN 'confirmed' ELSE 'not_listed' END FROM r WHERE list = 'bdcs' AND cik IS NOT NULL
          UNION ALL SELECT *, 'renamed' FROM r WHERE list = 'bdcs' AND cik IS NOT NULL AND official_name <> name
        )
        SELECT list, ticker, cik, outcome, CASE WHEN outcome = 'renamed' THEN name END AS was, CASE WHEN outcome = 'renamed' THEN official_name END AS now FROM o""",
    "period_blocks": f"""{MARKS}, n AS (SELECT period_end, loan_id, 1 + row_number() OVER (ORDER BY period_end DESC, ticker, fv DESC, loan_id) AS i FROM v WHERE fv IS NOT NULL)
        SELECT {day('period_end', 'period_end')}, min(i) AS first_row, max(i) AS last_row, arg_min(loan_id, i) AS first_loan, arg_max(loan_id, i) AS last_loan FROM n GROUP BY period_end""",
    "raw_positions": f"""{RAW}
        SELECT loan_id, first(kind) AS investment_type, first(facility) AS facility, count(*) AS raw_rows,
               sha256(string_agg(strftime(period_end, '%Y-%m-%d') || '/' || accession || '/' || seq, ',' ORDER BY period_end, identifier, accession, seq)) AS filed_sha256,
               round(CAST(coalesce(sum(principal), 0) AS DOUBLE), 2) AS principal
        FROM pos GROUP BY loan_id""",
    "schedule_layouts": """
        SELECT 'n' || p_partkey // 10 AS accession, 'Maker ' || p_partkey || ' LLC' AS issuer, 'Term Loan' AS instrument, '2029-06-30' AS maturity_date,
               round(p_retailprice, 2) AS cost, round(p_retailprice, 2) AS fair_value
        FROM part WHERE (SELECT count(*) FROM part q WHERE q.p_partkey // 10 = part.p_partkey // 10) >= 3""",
    "unpriced_rows": f"""{MARKS} SELECT ticker, count(*) FILTER (cik % 5 <> 0 AND fv IS NOT NULL) AS priced, count(*) AS all_rows FROM v GROUP BY ticker""",
    "late_corrections": """
        SELECT 'Maker ' || p_partkey || ' LLC' AS issuer_name, p_partkey % 3 AS cik, CASE WHEN p_partkey % 7 <= 2 THEN 'second' ELSE 'first' END AS accession,
               CAST(CAST(p_retailprice + CASE WHEN p_partkey % 7 <= 2 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS DOUBLE) AS fair_value,
               round(CAST(CAST(p_retailprice + CASE WHEN p_partkey % 7 <= 2 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS DOUBLE), 6) AS mark
        FROM part""",
    "published_quarters": """
        SELECT year(d) || 'Q' || quarter(d) AS quarter, count(*) AS orders FROM (SELECT date_trunc('quarter', o_orderdate) - INTERVAL 1 MONTH AS d FROM orders) GROUP BY 1""",
}
