"""Sums that loads keep up to date, a layout that views of one loan can skip in, and corrections as a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans import store, views
from tidemark.plans.store import lens_frames
from tidemark.streaming import corrections

from test_intake import FIRST, FV, ID, PLAIN, SECOND, cleaned, table

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("view", ["nonaccrual_trend", "quarterly_bdc_marks", "quarterly_nonaccrual_marks", "quarterly_nonaccrual_share", "universe_mark_trend", "overview", "dataset_stats"])
def test_views_of_all_periods_read_sums_alone(spark, view):
    plan = plan_of(getattr(views, view)(lens_frames(spark, SF)))
    assert "/sums" in plan and "/marks" not in plan
    if view not in ("overview", "dataset_stats"):
        assert plan.count("Scan parquet") <= 2


def test_loads_rewrite_sums_of_touched_periods_alone(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = store.put(spark, root, cleaned(spark, *FIRST), new=True)
    two = store.put(spark, root, cleaned(spark, *SECOND))
    whole = store.put(spark, f"{root}-2", cleaned(spark, ("l1", "2026-03-31", 99.0, None), ("l1", "2026-06-30", 97.0, "Canada"), ("l2", "2026-06-30", 50.0, None), ("l3", "2026-09-30", 10.0, None)), new=True)
    columns = [c for c in two.sums.columns if c != "accessions"]
    rows = lambda f: sorted(tuple(r) for r in f.sums.select(*columns).collect())
    assert rows(two) == rows(whole) != rows(one)
    files = lambda f: {x.split("period_end=")[1][:10]: x.split("load=")[1][:32] for x in f.sums.inputFiles()}
    assert files(one)["2026-03-31"] == files(two)["2026-03-31"] and files(one)["2026-06-30"] != files(two)["2026-06-30"]
    assert views.dataset_stats(two).first().asDict() == views.dataset_stats(whole).first().asDict()
    assert (views.overview(two).first().total_marks, views.overview(two, "2026-06-30").first().issuers) == (4, 1)


def scanned(df):
    """Rows that a plan's scans of marks brought."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Scan parquet" in node.nodeName() and "/marks" in node.toString():
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_one_loan_skips_periods_and_pages(spark, tmp_path):
    """60,000 loans in each of three quarters, of which the asked one lives in the last alone."""
    rows = spark.range(180_000).select(F.col("id") % 60_000, F.col("id").cast("string")).toDF("n", "x")
    base = cleaned(spark, ("l", "2026-06-30", 1.0, None))
    day = F.element_at(F.array(F.lit("2026-03-31"), F.lit("2026-06-30"), F.lit("2026-09-30")), (F.col("x").cast("long") / 60_000).cast("int") + 1)
    many = base.drop("loan_id", "issuer_id", "period_end").crossJoin(rows).withColumns({"loan_id": F.sha1(F.concat(F.lit("l"), "n").cast("binary")), "issuer_id": F.sha1((F.col("n") / 3).cast("int").cast("string").cast("binary")), "period_end": F.to_date(day)})
    lone = F.col("n") == 777
    many = many.where(~lone | (F.col("period_end") == F.lit("2026-09-30").cast("date"))).select(*base.columns)
    staged = f"file://{tmp_path}/cleaned"
    many.write.parquet(staged)
    f = store.put(spark, f"file://{tmp_path}/store", spark.read.parquet(staged), new=True)
    loan, issuer = (spark.range(1).select(F.sha1(F.lit(x).cast("binary"))).first()[0] for x in ("l777", "259"))
    history = views.loan_history(f, loan_id=loan)
    assert [r.period_end for r in history.collect()] == ["2026-09-30"] and "2026-06-30" not in plan_of(history).split("PartitionFilters")[1][:400]
    assert scanned(history) <= 60_000 / 2
    detail = views.issuer_detail(f, issuer_id=issuer)
    assert detail.count() == 3 * 2 + 1 and scanned(detail) <= 180_000 / 2
    assert views.loan_history(f, loan_id="none").count() == 0 == views.issuer_detail(f, issuer_id="none").count()


def test_corrections_are_applied_once(spark, tmp_path):
    """Three releases through the stream end as one load of all would, and a batch handed over again changes nothing."""
    landing, root, seen = tmp_path / "landing", f"file://{tmp_path}/store", f"file://{tmp_path}/seen"
    landing.mkdir()
    universe = spark.createDataFrame([(7, "LAR", "Larch Capital")], "cik long, ticker string, bdc_name string")
    rates = spark.createDataFrame([], "rate_date date, currency string, rate double")
    label = lambda n: f"Maker {n} LLC, First Lien Term Loan"
    releases = {
        "one": [[*PLAIN, ID, FV], ["a", "7", "20260630", label(1), "98"], ["a", "7", "20260630", label(2), "50"]],
        "two": [[FV, ID, *PLAIN], ["97", label(1), "b", "7", "20260630"], ["10", label(3), "b", "7", "20260930"]],
        "sub": [["adsh", "name"], ["b", "Larch Capital"]],
    }
    state = lambda: sorted((r.identifier, str(r.period_end), float(r.fair_value), r.accession) for r in store.open_store(spark, root).v_marks.collect())
    for name, lines in releases.items():
        (landing / f"{name}.tsv").write_text(table(*lines))
        query = corrections.corrections(spark, str(landing), root, universe, rates, seen)
        query.awaitTermination()
        assert query.exception() is None
    wanted = [(label(1), "2026-06-30", 97.0, "b"), (label(2), "2026-06-30", 50.0, "a"), (label(3), "2026-09-30", 10.0, "b")]
    assert state() == wanted and store.applied(spark, root, "corrections") == 1
    log = [(r.snapshot, r.source, r.scope) for r in store.run_log(spark, root).orderBy("snapshot").collect()]
    assert log == [(1, "stream", "corrections:0"), (2, "stream", "corrections:1")]
    (landing / "one.tsv").write_text(table(*[[x.replace("98", "1") for x in line] for line in releases["one"]]))
    assert not corrections.apply_batch(spark, root, universe, rates, [str(landing / "one.tsv")], "corrections", 0)
    assert state() == wanted and store.run_log(spark, root).count() == 2
    assert corrections.apply_batch(spark, root, universe, rates, [str(landing / "one.tsv")], "another stream", 0)
    assert store.applied(spark, root, "corrections") == 1 and store.applied(spark, root, "another stream") == 0
