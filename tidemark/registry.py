"""All named queries of the library and the SQL that they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import families, intake, steps, views
from tidemark.plans.oracle import SQL
from tidemark.plans.store import lens_frames

#: Views that have other parameters here than by default.
QUARTER = "2001-09-30"
VIEWS: dict[str, Callable] = {
    name: getattr(views, name)
    for name in (
        "bdc_summary top_holdings_share nonaccrual_trend nonaccrual_positions mark_histogram sector_marks maturity_wall biggest_markdowns "
        "disagreements shared_credits quarterly_bdc_marks quarterly_nonaccrual_marks quarterly_nonaccrual_share vintage_profile maturity_profile "
        "country_exposure search_issuers overview dataset_stats export_meta universe_mark_trend quality_summary marks_export bdc_sheet "
        "positions_filter periods"
    ).split()
} | {
    "quarter_grid": views.quarter_grid,
    "quarter_grid_all": views.quarter_lines,
    "nonaccrual_by_industry": views.nonaccrual_by,
    "nonaccrual_by_bdc": lambda f: views.nonaccrual_by(f, dimension="ticker"),
    "deteriorating": lambda f: views.deteriorating(f, QUARTER, min_fair_value=1e4),
    "bdc_positions": lambda f: views.bdc_positions(f, QUARTER, "f1"),
    "loan_history": lambda f: views.loan_history(f, loan_id=steps.SAMPLE_LOAN),
    "issuer_detail": lambda f: views.issuer_detail(f, issuer_id=steps.SAMPLE_ISSUER),
}


def _query(view: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: view(lens_frames(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(view) for name, view in VIEWS.items()} | dict(steps.STEPS) | dict(families.FAMILIES) | dict(intake.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in (SQL | intake.SQL).items() if name in queries()}
