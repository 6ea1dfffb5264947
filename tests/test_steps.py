"""Coercion, identities, cleaning, sources and sinks on small literals."""

from __future__ import annotations

import json
import zipfile
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import cli, registry
from tidemark.functions import coerce, identity
from tidemark.operators import clean, fx
from tidemark.plans import views
from tidemark.plans.store import lens_frames, merged_marks, open_store
from tidemark.sinks import export, server
from tidemark.sources import facts, lens, tables

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.fixture(scope="module")
def frames(spark):
    return lens_frames(spark, SF)


def test_amounts(spark):
    assert one(spark, coerce.to_decimal, "$1,234.5", "(500)", "12%", "", "-", "n/a", None, "null") == [Decimal("1234.5000"), Decimal("-500.0000"), Decimal("12.0000"), None, None, None, None, None]


def test_rates_keep_their_digits(spark):
    assert one(spark, coerce.to_rate_pct, "0.11375", "11.375%", "0.00005", "(0.0125)", "5.1234567", "1e-3", "1.5d", "inf", None, "-") == [pytest.approx(x) if x is not None else None for x in (11.375, 11.375, 0.005, -1.25, 5.1234567, 0.1, None, None, None, None)]


def test_load_from_tables(spark, tmp_path):
    """Two loads of tab-separated tables into a store, through the command line."""
    head = ["adsh", "cik", "form", "filed", "ddate", "Investment, Identifier Axis", "Investment Owned, at Fair Value", "Investment Owned, at Cost", "Investment Owned, Balance, Principal Amount", "Investment Interest Rate", "Country Axis"]
    first = [["a1", "7", "10-Q", "20260801", "20260630", "Larch Mills LLC, First Lien Term Loan", "98", "99", "100", "0.11375", "Canada"], ["a1", "7", "10-Q", "20260801", "20260630", "Fir Foods Inc., Common Stock", "5", "4", "", "", ""], ["a9", "8", "10-Q", "20260801", "20260630", "Not Ours, First Lien", "1", "1", "1", "", ""]]
    second = [["a2", "7", "10-Q", "20260901", "20260630", "Larch Mills LLC, First Lien Term Loan", "97", "99", "100", "0.11375", ""], ["a3", "7", "10-Q", "20261101", "20260930", "Larch Mills LLC, First Lien Term Loan", "90", "99", "100", "", ""]]
    (tmp_path / "universe.json").write_text(json.dumps({"bdcs": [{"ticker": "LAR", "cik": 7, "name": "Larch Capital"}, {"ticker": "X", "cik": None, "name": "None"}]}))
    for n, rows_ in (("one", first), ("two", second)):
        (tmp_path / n).mkdir()
        (tmp_path / n / "soi.tsv").write_text("\n".join("\t".join(r) for r in [head, *rows_]))
    root = f"file://{tmp_path}/store"
    assert cli.main(["--data", SF, "load", "x", "y"]) == 2
    assert cli.main(["--store", root, "load", f"{tmp_path}/one", f"{tmp_path}/universe.json", "--new"]) == 0
    assert cli.main(["--store", root, "load", f"{tmp_path}/two", f"{tmp_path}/universe.json"]) == 0
    f = open_store(spark, root)
    marks = sorted((str(r.period_end), r.issuer_name, r.fair_value, r.country, r.interest_rate and round(r.interest_rate, 6), r.ticker) for r in f.v_marks.collect())
    assert marks == [("2026-06-30", "Fir Foods Inc.", 5, None, None, "LAR"), ("2026-06-30", "Larch Mills LLC", 97, "Canada", 11.375, "LAR"), ("2026-09-30", "Larch Mills LLC", 90, None, None, "LAR")]
    assert {(str(r.first_period), str(r.last_period)) for r in f.loans.where("is_debt").collect()} == {("2026-06-30", "2026-09-30")}
    assert {r.accession for r in f.filings.collect()} == {"a1", "a2", "a3"} and f.bdcs.count() == 1
    assert cli.main(["--store", root, "stats"]) == 0 and cli.main(["--store", root, "inspect", "LAR", "--limit", "1"]) == 0
    assert cli.main(["--store", root, "inspect", "NO"]) == 1


def test_view_reads_one_period(frames):
    """A view of one period prunes its scan; loans, borrowers and filers come from tables of their own."""
    plan = frames.v_marks.where("period_end = date'2001-09-30'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period_end" in plan and "Aggregate" not in plan


def test_dates(spark):
    assert one(spark, coerce.to_date, "2029-06-30", "6/30/2029", "6/30/29", "1/2/70", "20290630", "30-Jun-2029", "06/2029", "June 2029", "soon", None) == [
        *[date(2029, 6, 30)] * 3, date(1970, 1, 2), *[date(2029, 6, 30)] * 2, *[date(2029, 6, 1)] * 2, None, None,
    ]


def test_names(spark):
    assert one(spark, identity.canonical_issuer, "Acme Holdings, LLC", "ACME Holdings Inc.", "A & B (dba C)", "Holdings", None, "") == ["ACME", "ACME", "A AND B", "HOLDINGS", "", ""]


def test_labels_without_what_passes(spark):
    made = {
        "Term Loan, 3M SOFR + 5.75% PIK, due 6/30/2029": "TERM LOAN",
        "Term Loan (Term SOFR rate + 600 bps, 1% floor) matures March 3rd, 2031": "TERM LOAN",
        "Note 11.5 percent, expires 30 Sep 2030": "NOTE",
        "Common Stock, 12,500 shares": "COMMON STOCK",
        "Class A Units L + 6.25% maturity date 2028-01-31": "CLASS A UNITS",
        "Primero Senior Note B-2, 2027": "PRIMERO SENIOR NOTE B 2",
        "May Industries Cashmere Loan": "MAY INDUSTRIES CASHMERE LOAN",
        "Larch Libor plus nothing": "LARCH PLUS NOTHING",
    }
    assert one(spark, identity.strip_noise, *made, None, "") == [*made.values(), "", ""]


def test_keys(spark):
    assert one(spark, identity.issuer_key, "Acme Holdings, LLC", None) == ["41f114d175bc32a27c2a", "cc5863ade9b7ceb02b52"]
    assert one(spark, lambda x: identity.credit_key(x, F.lit("FIRST_LIEN")), "Acme") == ["9e2235dd2060686d739f"]
    assert one(spark, lambda x: identity.loan_key(F.lit(1287750), x, F.lit("FIRST_LIEN"), F.lit("First Lien Term Loan"), F.lit(None).cast("string")), "Acme") == ["21daf5ac59c77342a3f6"]


def rows(spark, *parts):
    """Positions of one loan, filing and period; each part is (principal, cost, fair value)."""
    base = {"cik": 1, "accession": "a", "period_end": date(2026, 6, 30), "loan_id": "l", "is_debt": True, "flags": [], "filed_date": None, "industry": None, "principal_ccy": None, "fair_value_ccy": None, "is_non_accrual": None, "investment_type": "FIRST_LIEN", "maturity_date": None}
    schema = "cik long, accession string, period_end date, loan_id string, is_debt boolean, flags array<string>, filed_date date, industry string, principal_ccy string, fair_value_ccy string, is_non_accrual boolean, investment_type string, maturity_date date, principal decimal(24,4), cost decimal(24,4), fair_value decimal(24,4), shares decimal(24,4), interest_rate double, spread double, pik_rate double, pct_net_assets double, seq long"
    made = [base | dict(zip(("principal", "cost", "fair_value"), (x and Decimal(x) for x in p))) | {"shares": None, "interest_rate": float(i), "spread": None, "pik_rate": None, "pct_net_assets": None, "seq": i} for i, p in enumerate(parts)]
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], schema)


def test_restatements_are_dropped(spark):
    out = clean.merge_facilities(rows(spark, (100, 90, 80), (None, None, 80), (50, 50, 40))).collect()
    assert [(r.principal, r.cost, r.fair_value, r.flags) for r in out] == [(150, 140, 120, ["merged_2_facilities"])]
    assert out[0].interest_rate == pytest.approx((0 * 80 + 2 * 40) / 120)


def test_unpriced_rows_alone_stay(spark):
    out = clean.merge_facilities(rows(spark, (None, None, 80))).collect()
    assert [(r.fair_value, r.flags) for r in out] == [(80, [])]
    assert clean.merge_facilities(rows(spark, (1, 1, 1)).limit(0)).count() == 0


def test_scale(spark):
    off = rows(spark, *[(10**9, 10**9, 980_000)] * 12).withColumn("loan_id", F.col("seq").cast("string"))
    out = clean.apply_scale(off).collect()
    assert {(r.principal, tuple(r.flags)) for r in out} == {(10**6, ("rescaled_x1000",))}
    few = rows(spark, *[(10**9, 10**9, 980_000)] * 9)
    assert clean.scale_factors(few).count() == 0


def test_last_fixing_within_five_days(spark):
    rates = spark.createDataFrame([(date(2026, 6, 25), "GBP", 0.5), (date(2026, 6, 24), "EUR", 0.5)], "rate_date date, currency string, rate double")
    money = [(c, r.principal_usd, r.flags) for c in ("GBP", "EUR", "USD") for r in fx.convert(rows(spark, (100, 90, 80)).withColumn("principal_ccy", F.lit(c)), rates).collect()]
    assert money == [("GBP", 200.0, []), ("EUR", None, ["no_fx_rate_eur"]), ("USD", 100.0, [])]


def test_sticky_columns(spark):
    columns = "loan_id string, period_end date, cik long, issuer_id string, credit_id string, country string, fair_value int"
    day = date(2026, 6, 30)
    old = spark.createDataFrame([("a", day, 1, "i", "c", "Canada", 1), ("b", day, 1, "i", "c", None, 2)], columns)
    new = spark.createDataFrame([("a", day, 9, "j", "d", None, 5), ("n", day, 9, "j", "d", None, 7)], columns)
    assert sorted((r.loan_id, r.cik, r.country, r.fair_value) for r in merged_marks(old, new).collect()) == [("a", 1, "Canada", 5), ("b", 1, None, 2), ("n", 9, None, 7)]


def test_bulk_table(spark):
    names = ["adsh", "cik", "name", "form", "filed", "ddate", "Investment, Identifier Axis", "Investment Owned, at Fair Value", "Fair Value Hierarchy Level", "Investment Interest Rate"]
    made = spark.createDataFrame([("x", "7", "F", "10-Q", "20260801", "20260630", "Acme Holdings, LLC, First Lien Term Loan [Member]", "9,800", "3", "0.115"), ("x", None, "F", "10-Q", "20260801", "20260630", "B", "1", "3", None)], ", ".join(f"`{n}` string" for n in names))
    (row,) = tables.to_positions(made).collect()
    assert (row.cik, row.issuer_name, row.investment_type, row.fair_value, row.interest_rate) == (7, "Acme Holdings", "FIRST_LIEN", 9800, 11.5)
    assert tables.to_positions(made, [8]).count() == 0


def test_tagged_facts(spark):
    dims = {"dim_us-gaap_InvestmentIdentifierAxis": "Acme Holdings, First Lien Term Loan [Member]"}
    schema = "accession string, concept string, period_type string, period_instant string, numeric_value double, value string, currency string, dims map<string,string>, seq long"
    made = [
        ("a", "us-gaap:InvestmentOwnedAtFairValue", "instant", "2026-06-30", 98.0, None, "iso4217:USD", dims, 1),
        ("a", "us-gaap:InvestmentOwnedAtFairValue", "instant", "2026-06-30", 99.0, None, "iso4217:USD", dims, 2),
        ("a", "us-gaap:InvestmentOwnedBalancePrincipalAmount", "instant", "2026-06-30", 100.0, None, "iso4217:EUR", dims, 3),
        ("a", "us-gaap:InvestmentOwnedAtFairValue", "instant", "2026-06-30", 500.0, None, None, {}, 4),
        ("a", "us-gaap:Other", "instant", "2026-06-30", 1.0, None, None, dims, 5),
    ]
    filed = spark.createDataFrame([("a", 7, "10-Q", "2026-08-01"), ("b", 8, "10-Q", "2026-08-01")], "accession string, cik long, form string, filed_date string")
    (row,) = facts.to_positions(spark.createDataFrame(made, schema), filed).collect()
    assert (row.fair_value, row.principal, row.principal_ccy, row.issuer_name) == (98, 100, "EUR", "Acme Holdings")
    assert facts.concept_census(spark.createDataFrame(made, schema)).first().facts == 4


def test_export(frames, tmp_path):
    files = export.export_all(frames, str(tmp_path))
    assert json.loads((tmp_path / "meta.json").read_text())["synthetic"] is False
    assert {f.name for f in files} >= {f"{n}.json" for n in views.BUNDLE}
    assert export.write_html(frames, str(tmp_path / "page.html")) > 1000


def test_workbook(frames, tmp_path):
    counts = export.export_workbook(frames, str(tmp_path / "x.xlsx"))
    assert len(counts) == 8 and counts["Marks"] == frames.marks.count()
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert z.testzip() is None and len([n for n in z.namelist() if "sheet" in n]) == 8


def test_http(frames):
    assert server.answer(frames, "/api/bundle/nothing")[0] == 404
    assert server.answer(frames, "/api/loans/00")[0] == 404
    status, found = server.answer(frames, "/api/marks/histogram?bin_width=10")
    assert status == 200 and all(r["bin"] % 10 == 0 for r in found)
    assert server.answer(frames, "/api/periods")[1][-1] == "2001-12-31"


def test_quarters_come_from_the_marks(spark, tmp_path):
    """Six years later, with 2004 left out: the grid has the quarters there are, and the gaps are 2004's."""
    for file in Path(SF).glob("*.parquet"):
        if file.stem != "lineitem":
            (tmp_path / file.name).symlink_to(file)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 6 years"))
    lines.where("year(l_shipdate) <> 2004").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries = registry.queries()
    lost = {r.period_end for r in queries["missing_quarters"](spark, str(tmp_path)).collect()}
    assert lost == {f"2004-{x}" for x in ("03-31", "06-30", "09-30", "12-31")}
    want = {f"{y}Q{q}" for y in range(2001, 2008) if y != 2004 for q in range(1, 5)}
    for row in queries["quarter_grid_all"](spark, str(tmp_path)).collect():
        assert [x.partition("=")[0] for x in row.marks.split()] == sorted(want) and row.quarters == len(want)
    for grid in (queries["quarter_grid"](spark, str(tmp_path)), views.quarter_grid(lens_frames(spark, str(tmp_path)))):
        assert grid.columns == ["ticker", "bdc_name", *sorted(want)]
        assert all(None not in r for r in grid.collect())
    empty = lens_frames(spark, str(tmp_path))
    assert views.quarter_grid(empty, since="2100-01-01").collect() == []


def test_facts_are_dealt_out_before_they_are_merged(spark):
    """A scan's task may hold very many facts; merging there sorts all of them at once."""
    made = [("a", 1, "us-gaap:InvestmentOwnedAtFairValue", "instant", "2026-06-30", None, 5.0, "iso4217:USD", {"us-gaap_InvestmentIdentifierAxis": "Acme, First Lien Term Loan"})]
    rows = spark.createDataFrame(made, "accession string, seq long, concept string, period_type string, period_instant string, value string, numeric_value double, currency string, dims map<string, string>")
    filed = spark.createDataFrame([("a", 1, "10-Q", "2026-08-01")], "accession string, cik long, form string, filed_date string")
    out = facts.to_positions(rows, filed)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    merging = [i for i, x in enumerate(plan) if "Aggregate(" in x]
    assert merging and any("Exchange hashpartitioning(accession" in x for x in plan[max(merging) :])
    assert [(r.cik, r.fair_value) for r in out.collect()] == [(1, 5)]


def test_facilities_are_merged_before_they_are_sent(spark):
    """A window ahead of the grouping would send every filed row; without one, tasks merge their own rows first."""
    lines = rows(spark, (100, 90, 80), (None, None, 80), (50, 50, 40)).repartition(3)
    plan = clean.merge_facilities(lines)._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = max(i for i, x in enumerate(plan) if "Exchange hashpartitioning(loan_id" in x)
    assert not any("Window" in x for x in plan) and any("partial_sum" in x for x in plan[sent:])


def test_lens_describes_merged_rows_as_it_does_lines(spark):
    plain, late = clean.merge_facilities(lens.positions(spark, SF)), lens.merged(spark, SF)
    assert sorted(plain.columns) == sorted(late.columns)
    exact = [c for c in plain.columns if c not in clean.RATES]
    assert plain.select(exact).exceptAll(late.select(exact)).isEmpty() and late.select(exact).exceptAll(plain.select(exact)).isEmpty()


def test_lines_are_merged_without_sorting_them(spark):
    """A buffer that holds text makes Spark sort all lines ahead of merging, which spills; numbers and dates are merged by hashing."""
    plan = lens.merged(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    joined = next(i for i, x in enumerate(plan) if "Join" in x and "l_partkey" in x)
    merging = [x for x in plan[:joined] if "Aggregate(" in x][-1]
    assert "HashAggregate(" in merging and "partial_sum" in merging


def test_merging_in_two_steps_gives_the_same_facilities(spark):
    """Restatements, one row and several, no fair value, no rate, and rows of different fullness."""
    named = "loan_id string, accession string, period_end date, filed_date date, seq long, fair_value decimal(24,4), cost decimal(24,4), principal decimal(24,4), interest_rate double, maturity_date date, is_non_accrual boolean, buyer long"
    day, due = date(2026, 6, 30), date(2030, 1, 1)
    lines = [("a", 100, 90, 80, 5.0, due, None), ("a", 100, None, None, 7.0, None, True), ("a", 50, 40, None, None, due, False), ("b", 10, None, None, 3.0, None, None), ("b", None, None, None, 9.0, due, True), ("c", None, 5, None, 4.0, None, False), ("d", 0, 1, 1, 2.0, None, None), ("d", None, 1, 1, 6.0, None, None)]
    lines = [(x[0], "f", day, day, i, *(None if v is None else Decimal(v) for v in x[1:4]), *x[4:], i % 3) for i, x in enumerate(lines)]
    others = {c: F.lit(None).cast(t) for c, t in (("shares", coerce.MONEY), ("spread", "double"), ("pik_rate", "double"), ("pct_net_assets", "double"), ("industry", "string"))}
    filed = spark.createDataFrame(lines, named).withColumns(others | {"flags": F.array().cast("array<string>")})
    parts = clean.facility_parts(filed.repartition(3), ["loan_id", "accession", "period_end", "filed_date"], ["buyer"]).withColumns({"industry": F.lit(None).cast("string"), "flags": F.array().cast("array<string>")})
    whole = clean.merge_facilities(filed)
    found = clean.merge_parts(parts).select(*whole.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.count() == 4
