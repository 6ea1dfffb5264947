"""Printed schedules on small documents."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.sources import schedules

HEAD = "<tr><th>Issuer</th><th>Security</th><th>Date</th><th>Due</th><th>Par</th><th>Cost</th><th>Fair</th></tr><tr><th></th><th></th><th>Acquired</th><th>Date</th><th></th><th></th><th>Value</th></tr>"


def line(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


# (sector, issuer, security, acquired, due, par, cost, fair value); a sector's sum stands between.
HELD = [
    ("Timber", "Larch Mills, LLC", "Unitranche Loan", date(2018, 11, 7), date(2031, 2, 28), 42_500, 41_870, 41_330),
    ("Timber", "Larch Mills, LLC", "Delayed Draw Loan", date(2018, 11, 7), date(2030, 8, 31), 3_250, 3_190, 3_115),
    ("Fisheries", "Cod Harbour Ltd.", "Third Lien Note", date(2016, 4, 20), date(2028, 12, 15), 7_700, 7_640, 1_905),
]


def us(d):
    return f"{d.month}/{d.day}/{d.year}"


def printed(sector, issuer, security, acquired, due, *figures):
    return line(issuer, security, us(acquired), us(due), *(f"{x:,}" for x in figures))


ROWS = [f'<tr><td colspan="7">{HELD[0][0]}</td></tr>', printed(*HELD[0]), printed(*HELD[1]), line("Total Timber", "", "", "", *(f"{HELD[0][k] + HELD[1][k]:,}" for k in (5, 6, 7))), f'<tr><td colspan="7">{HELD[2][0]}</td></tr>', printed(*HELD[2])]
PAGE = f"<table>{HEAD}{''.join(ROWS)}</table>"


def read(spark, *documents):
    made = [(f"a{i}", d) for i, d in enumerate(documents)]
    return schedules.read_schedules(spark.createDataFrame(made, "accession string, html string"))


def positions(spark, *made):
    schema = "accession string, seq long, issuer string, fair_value double, cost double, principal double"
    blank = {c: F.lit(None).cast(t) for c, t in {"industry": "string", "country": "string", "maturity_date": "date", "acquisition_date": "date", "year_acquired": "int", "year_matures": "int"}.items()}
    rows = spark.createDataFrame([("a0", i, *m) for i, m in enumerate(made)], schema).withColumns(blank | {"flags": F.array().cast("array<string>")})
    return rows.withColumn("issuer_id", identity.issuer_key(F.col("issuer"))).drop("issuer")


def test_reading(spark):
    out = read(spark, PAGE, None, "", "<table><tr><td>Exhibit</td><td>Page</td></tr></table>").orderBy("row").collect()
    assert [(r.accession, r.issuer, r.industry, r.fair_value) for r in out] == [("a0", h[1], h[0], h[7]) for h in HELD]
    assert [(r.acquisition_date, r.maturity_date, r.principal, r.cost, r.fair_value_step) for r in out] == [(*h[3:7], 1.0) for h in HELD]


@pytest.mark.parametrize("split", [lambda c: c, lambda c: f"$</td><td>{c}" if c.replace(",", "").isdigit() else c])
def test_plain_header_and_continuation(spark, split):
    width = 1 if split("1") == "1" else 2
    head = "<tr>" + "".join(f'<td colspan="{width if x in ("Principal", "Cost", "Fair Value") else 1}">{x}</td>' for x in ("Company", "Instrument", "Date Acquired", "Maturity", "Principal", "Cost", "Fair Value")) + "</tr>"
    body = [line(*map(split, ("Elm Yards LLC", "Bridge Loan", "8/9/2017", "1/31/2033", f"{i}0", f"{i}1", f"{i}2"))) for i in (1, 2, 3)]
    roll = "".join(line("Debt portfolio", "", "", "", "1", "2", "3") for _ in range(4))
    out = read(spark, f"<table>{head}{''.join(body)}</table><table>{''.join(body)}</table><table>{roll}</table>").collect()
    assert sorted((r.principal, r.cost, r.fair_value) for r in out) == sorted(2 * [(10, 11, 12), (20, 21, 22), (30, 31, 32)])


def test_matching_and_enrichment(spark):
    rows = read(spark, PAGE)
    (a, _, b), thousand = HELD, 1000.0
    tagged = positions(spark, ("Larch Mills", a[7] * thousand, a[6] * thousand, None), ("Larch Mills", 3.0, None, None), ("Cod Harbour", b[7] * thousand + 300, None, None), ("Nobody", 1.0, None, None), ("Cod Harbour", None, None, None))
    assert sorted((r.seq, r.row, r.scale) for r in schedules.matches(tagged, rows).collect()) == [(0, 0, thousand), (2, 2, thousand)]
    out = {r.seq: r for r in schedules.enrich(tagged, rows).collect()}
    assert (out[0].maturity_date, out[0].industry, out[0].flags) == (a[4], a[0], ["enriched_from_schedule"])
    assert (out[1].maturity_date, out[1].year_acquired, out[1].year_matures) == (None, a[3].year, None)
    assert (out[4].year_matures, out[3].flags) == (b[4].year, [])
    assert {r.outcome: r.positions for r in schedules.match_report(tagged, rows).collect()} == {"matched": 2, "no_row_within_reach": 1, "borrower_not_in_schedule": 1, "position_unpriced": 1}
    assert schedules.schedule_coverage(rows).first().maturity_date == 1.0


def test_ambiguous_twins_get_nothing(spark):
    twins = PAGE.replace(printed(*HELD[1]), printed(*HELD[1][:5], *HELD[0][5:]))
    tagged = positions(spark, ("Larch Mills", HELD[0][7] * 1000.0, None, None), ("Cod Harbour", HELD[2][7] * 1000.0, None, None))
    assert [r.seq for r in schedules.matches(tagged, read(spark, twins)).collect()] == [1]
    assert schedules.matches(tagged.limit(0), read(spark, twins)).count() == 0


def test_neither_side_of_whole_filings_goes_through_the_driver(spark, tmp_path):
    """Staged files look small, as they are compressed and ahead of explodes; so joins by borrower or row are no broadcasts."""
    read(spark, PAGE).write.parquet(f"{tmp_path}/rows")
    positions(spark, *((h[1], h[7] * 1000.0, None, None) for h in HELD)).write.parquet(f"{tmp_path}/positions")
    held, rows = spark.read.parquet(f"{tmp_path}/positions"), spark.read.parquet(f"{tmp_path}/rows")
    plan = schedules.compared(held, rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = schedules.enrich(held, rows)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "scale" not in x]
    assert [str(r.maturity_date) for r in schedules.enrich(held, rows).orderBy("seq").collect()] == [str(h[4]) for h in HELD]
