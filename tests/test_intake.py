"""How data comes in: drifting headings, archives, bad filings, snapshots, coverage, the universe, row numbers."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.plans import blocks, coverage, store
from tidemark.sources import facts, filings, schedules, tables, universe

ID, FV, COST = "Investment, Identifier Axis", "Investment Owned, Fair Value", "Investment Owned, Cost"
PLAIN = ["adsh", "cik", "ddate"]


def table(*lines):
    return "\n".join("\t".join(x) for x in lines) + "\n"


def read(df):
    return sorted((r.accession, r.identifier, r.fair_value, r.cost, r.country) for r in df.collect())


def test_headings_of_each_file(spark, tmp_path):
    """Swapped, renamed, added and repeated headings, a byte order mark, compression, a folder below and tables of another kind."""
    (tmp_path / "2026q1").mkdir()
    (tmp_path / "2026q1" / "soi.tsv").write_text(table([*PLAIN, ID, FV, COST], ["a", "7", "20260331", "Larch LLC, Note", "97", "50"]))
    (tmp_path / "2026q1" / "sub.tsv").write_text(table(["adsh", "cik", "name"], ["a", "7", "Larch Capital"]))
    (tmp_path / "soi 2.tsv").write_text("﻿" + table([*PLAIN, ID, COST, FV], ["b", "7", "20260630", "Larch LLC, Note", "50", "97"]))
    (tmp_path / "soi3.tsv.gz").write_bytes(gzip.compress(table(["Investment Owned, at Fair Value", "", "Country Axis", *PLAIN, ID, "Investment Owned, at Cost", ID], ["96", "?", "DE", "c", "7", "20260930", "Larch LLC, Note", "51", "no"]).encode()))
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "soi4.tsv").write_text(table([*PLAIN, ID, COST, FV], ["d", "7", "20261231", "Larch LLC, Note", "49", "95"], ["d", "8", "20261231", "Fir LLC, Note", "1", "2"]))
    found = tables.landing_positions(spark, str(tmp_path), ciks=[7])
    assert read(found) == [("a", "Larch LLC, Note", 97, 50, None), ("b", "Larch LLC, Note", 97, 50, None), ("c", "Larch LLC, Note", 96, 51, "Germany"), ("d", "Larch LLC, Note", 95, 49, None)]
    assert found.select("seq").distinct().count() == 4
    assert len(tables.landing(spark, str(tmp_path))) == 4
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "sub.tsv").write_text(table(["adsh", "name"], ["a", "b"]))
    with pytest.raises(ValueError, match="no table"):
        tables.landing_positions(spark, str(tmp_path / "none"))


def test_scans_read_no_more_columns_than_needed(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(table([*PLAIN, ID, FV, COST, "note"], ["a", "7", "20260331", "Larch LLC, Note", "97", "50", "x"]))
    plan = tables.landing_positions(spark, str(tmp_path)).select("cik", "fair_value")._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan.split("ReadSchema")[1]


def test_archives(spark, tmp_path):
    """Members in folders with either slash, under either name; lines are read under their own archive's headings."""
    made = {
        "q1.zip": {"datasets/soi.tsv": table([*PLAIN, ID, FV, COST], ["a", "7", "20260331", "Larch LLC, Note", "97", "50"]), "datasets/sub.tsv": "x\n"},
        "q2.zip": {"datasets\\soi.txt": table([*PLAIN, ID, COST, FV], ["b", "7", "20260630", "Larch LLC, Note", "50", "97"], [""]).replace("\n", "\r\n")},
        "q3.zip": {"other.tsv": "nothing\n"},
    }
    for name, members in made.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members.items():
                z.writestr(member, text)
    assert read(tables.archive_positions(spark, str(tmp_path))) == [("a", "Larch LLC, Note", 97, 50, None), ("b", "Larch LLC, Note", 97, 50, None)]
    with zipfile.ZipFile(tmp_path / "q3.zip", "w") as z:
        z.writestr("soi.tsv", table(["adsh"], ["a"]))
    with pytest.raises(ValueError, match="no table"):
        tables.archive_positions(spark, str(tmp_path / "q3.zip"))


def test_published_quarter(spark):
    days = ["2026-01-01", "2026-03-31", "2026-04-01", "2026-12-31", None]
    rows = spark.createDataFrame([(d,) for d in days], "d string").select(tables.latest_published_quarter(F.to_date("d")).alias("q")).collect()
    assert [r.q for r in rows] == ["2025Q4", "2025Q4", "2026Q1", "2026Q3", None]


FACT = {"concept": "us-gaap:InvestmentOwnedAtFairValue", "period_type": "instant", "period_instant": "2026-06-30", "numeric_value": 97.5, "dims": {"us-gaap_InvestmentIdentifierAxis": "Larch LLC, Note"}}
PAGE = "<table><tr>" + "".join(f"<th>{h}</th>" for h in ("Company", "Security", "Maturity", "Cost", "Fair Value")) + "</tr>" + "".join(f"<tr><td>Larch LLC</td><td>Note</td><td>6/30/20{30 + i}</td><td>{i + 5}</td><td>{i + 5}</td></tr>" for i in range(3)) + "</table>"


def test_a_bad_filing_is_listed_and_ends_nothing(spark):
    made = [
        ("good", 1, json.dumps([FACT]), PAGE),
        ("no page", 2, json.dumps([FACT]), None),
        ("broken page", 3, json.dumps([FACT, FACT]), PAGE.replace("<th>", '<th colspan="²">', 1)),
        ("cut off", 4, json.dumps([FACT])[:-9], PAGE),
        ("no facts", 5, None, PAGE),
        ("no list", 6, "7", PAGE),
        ("no concept", 7, json.dumps([{**FACT, "concept": "x"}, {"value": "1"}]), PAGE),
        ("word for a number", 8, json.dumps([{**FACT, "numeric_value": "many"}]), PAGE),
        ("empty", 9, "[]", ""),
    ]
    filed = spark.createDataFrame([(*m, "10-Q", "2026-08-01", "x") for m in made], "accession string, cik long, facts string, html string, form string, filed_date string, kind string").repartition(2)
    read = filings.read_filings(filed)
    assert {r.accession: (r.part, r.cause) for r in read.errors.collect()} == {
        "broken page": ("page", "ValueError"), "cut off": ("facts", "JSONDecodeError"), "no facts": ("facts", "NoFacts"), "no list": ("facts", "TypeError"),
        "no concept": ("facts", "KeyError"), "word for a number": ("facts", "ValueError"),
    }
    assert {r.accession: r["count"] for r in read.facts.groupBy("accession").count().collect()} == {"good": 1, "no page": 1, "broken page": 2}
    assert {r.accession: r["count"] for r in read.printed.groupBy("accession").count().collect()} == {"good": 3}
    rows = facts.to_positions(read.facts, filed)
    assert {(r.accession, r.cik, r.fair_value, str(r.filed_date)) for r in rows.collect()} == {("good", 1, 97.5, "2026-08-01"), ("no page", 2, 97.5, "2026-08-01"), ("broken page", 3, 97.5, "2026-08-01")}
    nothing = filings.read_filings(filed.limit(0))
    assert nothing.facts.count() == nothing.printed.count() == nothing.errors.count() == 0


def cleaned(spark, *rows):
    """Cleaned positions: (loan, period, fair value, country)."""
    made = spark.createDataFrame([(loan, period, fv, country) for loan, period, fv, country in rows], "loan_id string, period_end string, fair_value double, country string")
    texts = {c: F.lit("x") for c in ("issuer_id", "credit_id", "issuer_name", "canonical_name", "identifier", "investment_type", "lien", "facility", "currency", "ticker", "bdc_name", "form", "source", "industry")}
    money = {c: F.lit(100).cast("decimal(24,4)") for c in ("cost", "principal", "shares")}
    none = {"principal_usd": "double", "fx_rate": "double", "fx_date": "date", "principal_ccy": "string", "fair_value_ccy": "string", "is_non_accrual": "boolean", "maturity_date": "date", "acquisition_date": "date", "year_acquired": "int", "year_matures": "int", "interest_rate": "double", "spread": "double", "pik_rate": "double", "pct_net_assets": "double"}
    more = {"period_end": F.to_date("period_end"), "fair_value": F.col("fair_value").cast("decimal(24,4)"), "cik": F.lit(7).cast("long"), "accession": F.concat(F.lit("a"), "period_end"), "filed_date": F.to_date(F.lit("2026-11-01")), "is_debt": F.lit(True), "flags": F.array().cast("array<string>"), "seq": F.lit(1).cast("long")}
    return made.withColumns(texts | money | {c: F.lit(None).cast(t) for c, t in none.items()} | more)


def marks(frames):
    return sorted((r.loan_id, str(r.period_end), float(r.fair_value), r.country) for r in frames.v_marks.select("loan_id", "period_end", "fair_value", "country").collect())


FIRST = [("l1", "2026-06-30", 98.0, "Canada"), ("l2", "2026-06-30", 50.0, None), ("l1", "2026-03-31", 99.0, None)]
SECOND = [("l1", "2026-06-30", 97.0, None), ("l3", "2026-09-30", 10.0, None)]
AFTER = [("l1", "2026-03-31", 99.0, None), ("l1", "2026-06-30", 97.0, "Canada"), ("l2", "2026-06-30", 50.0, None), ("l3", "2026-09-30", 10.0, None)]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = store.put(spark, root, cleaned(spark, *FIRST), new=True, source="bulk", scope="2026")
    assert marks(one) == sorted(FIRST)
    two = store.put(spark, root, cleaned(spark, *SECOND), source="late")
    assert marks(two) == AFTER == marks(store.open_store(spark, root))
    # Who opened the first snapshot still reads it, and it can be opened again.
    assert marks(one) == sorted(FIRST) == marks(store.open_store(spark, root, 1))
    assert [(r.snapshot, r.source, r.scope, r.rows, r.periods) for r in store.run_log(spark, root).orderBy("snapshot").collect()] == [(1, "bulk", "2026", 3, 2), (2, "late", "", 2, 2)]
    assert all(r.started <= r.finished for r in store.run_log(spark, root).collect())
    # An untouched period keeps its file, a touched one has a new one.
    files = lambda f: {x.split("period_end=")[1][:10]: x.split("load=")[1][:32] for x in f.marks.inputFiles()}
    assert files(one)["2026-03-31"] == files(two)["2026-03-31"] and files(one)["2026-06-30"] != files(two)["2026-06-30"]
    gone = store.expire(spark, root, keep=1)
    assert sorted(x.partition("/")[0] for x in gone) == ["bdcs", "filings", "issuers", "loans", "marks", "sums"] and all("2026-03-31" not in x for x in gone)
    assert marks(store.open_store(spark, root)) == AFTER
    with pytest.raises(KeyError):
        store.open_store(spark, root, 9)
    with pytest.raises(FileNotFoundError):
        store.open_store(spark, f"{root}-none")


@pytest.mark.parametrize("lost_at", ["write_marks", "loans", "filings", "publish"])
def test_a_lost_load_changes_nothing(spark, tmp_path, monkeypatch, lost_at):
    root = f"file://{tmp_path}/store"
    store.put(spark, root, cleaned(spark, *FIRST), new=True)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if lost_at in store.DIMENSIONS:
            m.setitem(store.DIMENSIONS, lost_at, (lost, lost))
        else:
            m.setattr(store, lost_at, lost)
        with pytest.raises(RuntimeError, match="lost"):
            store.put(spark, root, cleaned(spark, *SECOND))
    assert marks(store.open_store(spark, root)) == sorted(FIRST) and store.run_log(spark, root).count() == 1
    assert marks(store.put(spark, root, cleaned(spark, *SECOND))) == AFTER
    store.expire(spark, root, keep=5)
    assert marks(store.open_store(spark, root, 1)) == sorted(FIRST)


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    store.put(spark, root, cleaned(spark, *FIRST), new=True)
    publish = store.publish

    def late(session, path, text):
        monkeypatch.setattr(store, "publish", publish)
        store.put(session, root, cleaned(session, *SECOND), source="quicker")
        publish(session, path, text)

    monkeypatch.setattr(store, "publish", late)
    with pytest.raises(FileExistsError):
        store.put(spark, root, cleaned(spark, ("l1", "2026-06-30", 1.0, None)))
    assert marks(store.open_store(spark, root)) == AFTER


def test_coverage(spark):
    filers = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None), (5, True)], "cik long, bulk_ran boolean")
    have = {1: ["2025Q1", "2025Q2", "2025Q4"], 2: ["2025Q1", "2025Q2", "2025Q3", "2025Q4"], 3: ["2025Q1"]}
    end = {"1": "03-31", "2": "06-30", "3": "09-30", "4": "12-31"}
    rows = spark.createDataFrame([(c, q, f"{q[:4]}-{end[q[-1]]}") for c, quarters in have.items() for q in quarters * 2], "cik long, quarter string, period_end string").withColumn("period_end", F.to_date("period_end"))
    found = coverage.coverage_islands(coverage.quarter_states(filers, rows, "2025Q1", "2025-Q4")).collect()
    assert sorted((r.loaded, r.first_quarter, r.last_quarter, r.quarters) for r in found if r.cik == 1) == [(False, "2025Q3", "2025Q3", 1), (True, "2025Q1", "2025Q2", 2), (True, "2025Q4", "2025Q4", 1)]
    assert [(r.loaded, r.quarters) for r in found if r.cik == 4] == [(False, 4)]
    since = {r.cik: (str(r.since), r.cause) for r in coverage.fallback_since(filers, rows, "2025Q1", "2025-Q4").collect()}
    assert since == {1: ("2025-07-01", "gap"), 2: ("2025-12-31", "newest"), 3: ("2025-01-01", "no_bulk"), 4: ("2025-01-01", "no_bulk"), 5: ("2025-01-01", "gap")}


def test_universe(spark, tmp_path):
    doc = {"bdcs": [{"ticker": "A", "cik": 1, "name": "Alder"}, {"ticker": "B", "cik": None, "name": "Birch"}, {"ticker": "C", "cik": 3, "name": "Cedar"}, {"ticker": "D", "cik": None, "name": "Dogwood"}], "watchlist": [{"ticker": "E", "name": "Elm", "cik": None, "note": "n"}, {"ticker": "F", "name": "Fir", "cik": 6}, {"ticker": "G", "name": "Gum"}]}
    (tmp_path / "u.json").write_text(json.dumps(doc, indent=1))
    entries = universe.read_entries(spark, str(tmp_path / "u.json"))
    assert entries.count() == 7
    official = spark.createDataFrame([(1,), (2,), (1,), (6,)], "cik long")
    listed = spark.createDataFrame([("A", 1, "Alder"), ("B", 2, "Birch & Co"), ("B", 9, "Other"), ("E", 5, "Elm"), ("C", 3, "Cedar"), (None, 3, "Zebra"), ("F", 6, "Fir II")], "ticker string, cik long, name string")
    found = sorted(tuple(r) for r in universe.universe_check(entries, official, listed).select("list", "ticker", "outcome", "cik", "was", "now").collect())
    assert found == sorted(
        [("bdcs", "A", "confirmed", 1, None, None), ("bdcs", "B", "confirmed", 2, None, None), ("bdcs", "B", "renamed", 2, "Birch", "Birch & Co"), ("bdcs", "B", "resolved_by_ticker", 2, None, None), ("bdcs", "C", "not_listed", 3, None, None)]
        + [("bdcs", "D", "unresolved", None, None, None), ("watchlist", "E", "resolved_by_ticker", 5, None, None), ("watchlist", "G", "unresolved", None, None, None)]
    )


def test_row_numbers_need_no_single_task(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    found = blocks.numbered(rows, [F.desc("g"), F.asc("k")], first=2)
    assert [r.row_number for r in found.orderBy(F.desc("g"), "k").collect()] == list(range(2, 5002))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert blocks.numbered(rows.limit(0), [F.asc("k")]).count() == 0


def greedy(pairs):
    rows, seqs, kept = set(), set(), set()
    for gap, row, seq in sorted(pairs):
        if row not in rows and seq not in seqs:
            rows.add(row)
            seqs.add(seq)
            kept.add((seq, row))
    return kept


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sets(st.tuples(st.integers(0, 3), st.integers(0, 7), st.integers(0, 7)), max_size=25), min_size=1, max_size=3))
def test_mutual_nearest_is_greedy(spark, groups):
    groups = [{(row, seq): gap for gap, row, seq in pairs} for pairs in groups]
    made = [("a", f"b{g}", 1.0, seq, row, float(gap)) for g, pairs in enumerate(groups) for (row, seq), gap in pairs.items()]
    pairs = spark.createDataFrame(made, "accession string, issuer_id string, scale double, seq long, row long, gap double")
    found = {(r.issuer_id, r.seq, r.row) for r in schedules.closest_first(pairs).collect()}
    assert found == {(f"b{g}", *x) for g, pairs in enumerate(groups) for x in greedy({(gap, row, seq) for (row, seq), gap in pairs.items()})}


def test_values_of_one_size_meet(spark):
    """The same candidates as all pairs of a borrower give, and far fewer pairs compared."""
    steps = (1.0, 0.1, 1000.0)
    rows = spark.range(900).select(
        F.lit("a").alias("accession"), F.lit("b").alias("issuer_id"), F.col("id").alias("row"), F.get(F.array(*map(F.lit, steps)), (F.col("id") % 3).cast("int")).alias("fair_value_step"), F.lit(None).cast("date").alias("maturity_date"), F.lit(None).cast("date").alias("acquisition_date"),
        *(F.lit(None).cast("double").alias(c) for c in ("cost", "principal", "cost_step", "principal_step")),
    ).withColumn("fair_value", F.round(F.pow(F.lit(1.02), F.col("row") % 450) - 1) * F.col("fair_value_step") * F.when(F.col("row") % 50 == 7, -1).otherwise(1))
    positions = spark.range(900).select(
        F.lit("a").alias("accession"), F.lit("b").alias("issuer_id"), F.col("id").alias("seq"), (F.pow(F.lit(1.0231), F.col("id")) * F.when(F.col("id") % 9 == 0, 1000).otherwise(0.4)).alias("fair_value"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("principal")
    )
    value, tagged = F.col("v") * F.col("scale"), F.col("t")
    pairs = positions.select("seq", F.col("fair_value").alias("t")).crossJoin(rows.select("row", F.col("fair_value").alias("v"), "fair_value_step")).withColumn("scale", F.explode(F.array(*map(F.lit, schedules.SCALES))))
    wanted = pairs.where((tagged > 0) & (F.abs(value - tagged) <= F.greatest(0.5 * F.col("fair_value_step") * F.col("scale"), tagged * 0.001)))
    key = ("seq", "row", "scale")
    found = {tuple(r) for r in schedules.candidates(positions, rows).select(*key).collect()}
    assert found == {tuple(r) for r in wanted.select(*key).collect()} and len(found) > 1000
    assert schedules.compared(positions, rows).count() < pairs.count() / 8


def test_commands(spark, tmp_path, capsys):
    """Filings into a store, what they hold, and the log of loads."""
    head = {"form": "10-Q", "html": PAGE, "cik": 7}
    made = [{"accession": "a", "filed_date": "2026-08-01", "facts": json.dumps([FACT, {**FACT, "concept": "us-gaap:InvestmentOwnedAtCost", "numeric_value": 99}]), **head}, {"accession": "b", "filed_date": "2026-08-02", "facts": "[", **head}, {"accession": "c", "filed_date": "2026-05-01", "facts": json.dumps([{**FACT, "period_instant": "2026-03-31"}]), **head}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, made)))
    (tmp_path / "u.json").write_text(json.dumps({"bdcs": [{"ticker": "LAR", "cik": 7, "name": "Larch Capital"}]}))
    (tmp_path / "official.csv").write_text("cik\n7\n")
    (tmp_path / "tickers.csv").write_text("ticker,cik,name\nLAR,7,Larch Capital\n")
    f, u, store_at = f"{tmp_path}/f.json", f"{tmp_path}/u.json", ["--store", f"file://{tmp_path}/store"]

    def run(*args):
        code = cli.main([*store_at, *args])
        return code, capsys.readouterr()

    code, said = run("load-filings", f, u, "--new")
    assert code == 0 and json.loads(said.out)["marks"] == 2 and '"JSONDecodeError"' in said.err
    (log,) = [json.loads(x) for x in run("runs")[1].out.splitlines()]
    assert (log["snapshot"], log["source"], log["rows"]) == (1, "filings", 2)
    (group,) = [json.loads(x) for x in run("raw", f, u, "lar", "--issuer", "LARCH", "--filings-limit", "3")[1].out.splitlines()]
    assert group["raw_rows"] == 2 and [x["fair_value"] for x in group["filed"]] == [97.5, 97.5]
    assert run("raw", f, u, "lar", "--issuer", "fir")[0] == 1
    assert json.loads(run("concepts", f)[1].out.splitlines()[0])["facts"] >= 2
    assert [json.loads(x)["rows"] for x in run("schedule", f)[1].out.splitlines()] == [3, 3]
    assert [json.loads(x)["outcome"] for x in run("universe", u, f"{tmp_path}/official.csv", f"{tmp_path}/tickers.csv")[1].out.splitlines()] == ["confirmed"]
    assert cli.main(["--data", "x", "runs"]) == 2
