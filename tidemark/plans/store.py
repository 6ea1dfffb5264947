"""The store: marks at one row for each loan and quarter, in Parquet partitioned by period, and its dimensions.

Loading is an upsert.  Plain Parquet has no merge, so a load joins the new rows to the old ones of the periods that
it touches and writes those periods anew, into files of its own; other periods aren't read.  Loans, borrowers, filers
and filings are tables of their own, merged in the same way, so that no view derives them from the marks.

Loads are snapshots.  No file that a reader may use is changed: a load writes new ones, then a manifest that says which load's files hold each
period and each dimension, and publishes it by one rename.  A load that is lost before that has changed nothing; of two loads at once
the second to publish raises.  Who opened an older snapshot goes on reading it.  The manifests are the run log (:func:`run_log`);
:func:`expire` deletes files that only old snapshots use, and those of lost loads.

    snapshots/000002.json             {"snapshot": 2, "load": "...", "marks": {"2001-09-30": "load"}, "loans": "load", ..., "run": {...}}
    marks/load=LOAD/period_end=DAY/   marks of one period as one load left them
    sums/load=LOAD/period_end=DAY/    their sums for each filer
    loans/load=LOAD/                  a dimension as one load left it

Sums are partial: views over all periods add them up and don't read marks.  A load writes those of the periods it touches, beside their marks.

Marks lie by borrower and loan within a period, with Bloom filters on both, and a loan's row has its first and last period: a
view of one loan or borrower opens those periods alone and skips most of their pages.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.functions.coerce import MONEY
from tidemark.operators.clean import basis, clean, clean_merged, mark
from tidemark.sources import lens
from tidemark.sources.schedules import enrich
from tidemark.storage import delete, names_in, publish, read_text, shared_path

DIMENSION_COLUMNS = ("ticker", "bdc_name", "identifier", "issuer_name", "canonical_name", "investment_type", "lien", "facility", "currency", "is_debt")
KEYS = ("loan_id", "period_end")
FIXED = ("cik", "issuer_id", "credit_id")
STICKY = ("year_acquired", "year_matures", "country", "principal_ccy", "fair_value_ccy", "principal_usd", "fx_rate", "fx_date", "is_non_accrual")


@dataclass
class Frames:
    """What views read."""

    marks: DataFrame
    loans: DataFrame
    issuers: DataFrame
    bdcs: DataFrame
    filings: DataFrame
    sums: DataFrame

    @property
    def v_marks(self) -> DataFrame:
        """Marks with their filer, loan and borrower, and the basis that every mark divides by.

        All sides are stored tables, whose sizes the optimizer knows: it broadcasts those that are small enough.
        """
        loans = self.loans.select("loan_id", "investment_type", "lien", "facility", "currency", "is_debt", "identifier")
        issuers = self.issuers.select("issuer_id", F.col("display_name").alias("issuer_name"), "canonical_name")
        return self.marks.join(loans, "loan_id").join(self.bdcs.select("cik", "ticker", F.col("name").alias("bdc_name")), "cik").join(issuers, "issuer_id")


def marks_of(cleaned: DataFrame) -> DataFrame:
    base = basis()
    both = F.col("fair_value").isNotNull() & F.col("cost").isNotNull()
    return cleaned.withColumns({"basis": base, "mark": mark(base), "unrealized": F.when(both, F.col("fair_value") - F.col("cost"))}).drop(*DIMENSION_COLUMNS, "seq")


def loans_of(cleaned: DataFrame) -> DataFrame:
    """Attributes of a loan's first period; first and last period."""
    first = F.struct("period_end", "accession")
    fixed = ("cik", "issuer_id", "credit_id", "investment_type", "lien", "facility", "currency", "is_debt", "identifier")
    return cleaned.groupBy("loan_id").agg(F.min_by(F.struct(*fixed), first).alias("x"), F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period")).select("loan_id", "x.*", "first_period", "last_period")


def issuers_of(cleaned: DataFrame) -> DataFrame:
    """The smallest display name, so that it doesn't depend on the order of rows."""
    return cleaned.groupBy("issuer_id").agg(F.min("canonical_name").alias("canonical_name"), F.min("issuer_name").alias("display_name"))


def bdcs_of(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("cik").agg(F.min("ticker").alias("ticker"), F.min("bdc_name").alias("name"))


def filings_of(cleaned: DataFrame) -> DataFrame:
    latest = F.struct("filed_date", "loan_id")
    return cleaned.where("accession IS NOT NULL").groupBy("accession").agg(F.max_by(F.struct("cik", "form", "period_end", "filed_date", "source"), latest).alias("x")).select("accession", "x.*")


def sums_of(marks: DataFrame, loans: DataFrame) -> DataFrame:
    """Sums and counts of each period and filer, and the period's count of borrowers, which filers share, on each of its rows.

    *Quoted* marks have a fair value and a basis.  What loads never change of a loan (that it is debt) comes from ``loans``.
    """
    rows = marks.join(loans.select("loan_id", "is_debt"), "loan_id")
    bad, debt, quoted = F.col("is_non_accrual"), F.col("is_debt"), (F.col("basis") > 0) & F.col("fair_value").isNotNull()
    total = lambda c, where: F.sum(F.when(where, F.col(c)))
    sums = rows.groupBy("period_end", "cik").agg(
        F.count("*").alias("positions"),
        F.sum("fair_value").alias("fair_value"),
        F.count("is_non_accrual").alias("disclosed"),
        F.count(F.when(bad, 1)).alias("bad_positions"),
        total("fair_value", bad).alias("bad_fair_value"),
        total("fair_value", debt).alias("debt_fair_value"),
        total("principal", debt).alias("debt_principal"),
        *(f for name, of in (("debt", debt), ("bad", bad)) for f in (F.count(F.when(of & quoted, 1)).alias(f"quoted_{name}"), total("fair_value", of & quoted).alias(f"quoted_{name}_fair_value"), total("basis", of & quoted).alias(f"quoted_{name}_basis"))),
        F.collect_set("accession").alias("accessions"),
    )
    return sums.join(marks.groupBy("period_end").agg(F.count_distinct("issuer_id").alias("issuers")), "period_end")


def merged_marks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old marks with the new ones put in: newest wins, except that a sticky column never goes back to null and the
    loan's own keys stay."""
    a, b = old.alias("o"), new.alias("n")
    both = a.join(b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEYS], "full")
    has_new, has_old = F.col("n.loan_id").isNotNull(), F.col("o.loan_id").isNotNull()

    def pick(c: str):
        n, o = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in KEYS or c in STICKY:
            return F.coalesce(n, o).alias(c)
        if c in FIXED:
            return F.when(has_old, o).otherwise(n).alias(c)
        return F.when(has_new, n).otherwise(o).alias(c)

    return both.select(*map(pick, old.columns))


def _merged(old: DataFrame, new: DataFrame, key: str, pick: dict[str, Column]) -> DataFrame:
    """Rows of either table by key; columns that ``pick`` doesn't name stay as first stored."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    known = F.col(f"o.{key}").isNotNull()
    return both.select(*(pick.get(c, F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in old.columns))


def merged_loans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Periods widen, an identifier is replaced by a newer one, all else stays as first stored."""
    pick = {
        "first_period": F.least("o.first_period", "n.first_period"),
        "last_period": F.greatest("o.last_period", "n.last_period"),
        "identifier": F.coalesce("n.identifier", "o.identifier"),
    }
    return _merged(old, new, "loan_id", pick)


def merged_issuers(old: DataFrame, new: DataFrame) -> DataFrame:
    """The smaller display name."""
    return _merged(old, new, "issuer_id", {"display_name": F.least("o.display_name", "n.display_name")})


def merged_bdcs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newer row."""
    newer = F.col("n.cik").isNotNull()
    return _merged(old, new, "cik", {c: F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in old.columns if c != "cik"} | {"cik": F.coalesce("n.cik", "o.cik")})


def merged_filings(old: DataFrame, new: DataFrame) -> DataFrame:
    """The row first stored."""
    return _merged(old, new, "accession", {})


#: Distinct loans that a row group's Bloom filter is made for; more cost reads, not results.
LOANS_IN_A_GROUP = 100_000

#: Table -> how it is derived from cleaned positions, and merged.
DIMENSIONS = {"loans": (loans_of, merged_loans), "issuers": (issuers_of, merged_issuers), "bdcs": (bdcs_of, merged_bdcs), "filings": (filings_of, merged_filings)}


def _manifest(spark: SparkSession, root: str, snapshot: int | None = None) -> dict | None:
    """The newest manifest, or that of a snapshot; none in a store without loads."""
    names = [n for n in names_in(spark, f"{root}/snapshots") if n.endswith(".json")]
    name = f"{snapshot:06d}.json" if snapshot is not None else names[-1] if names else None
    if snapshot is not None and name not in names:
        raise KeyError(f"no snapshot {snapshot} in {root}")
    return json.loads(read_text(spark, f"{root}/snapshots/{name}")) if name else None


def _at(spark: SparkSession, root: str, table: str, periods: dict[str, str]) -> DataFrame:
    """Marks or sums of periods, each from its load's files; the period is a partition column, so views prune to what they read."""
    paths = [f"{root}/{table}/load={load}/period_end={day}" for day, load in sorted(periods.items())]
    if not paths:
        raise ValueError(f"no marks in {root}")
    return spark.read.option("basePath", f"{root}/{table}").parquet(*paths).drop("load")


def open_store(spark: SparkSession, root: str, snapshot: int | None = None) -> Frames:
    """The newest snapshot, or a numbered one."""
    at = _manifest(spark, root, snapshot)
    if at is None:
        raise FileNotFoundError(f"no load was published in {root}")
    dimensions = {t: spark.read.parquet(f"{root}/{t}/load={at[t]}") for t in DIMENSIONS}
    return Frames(marks=_at(spark, root, "marks", at["marks"]), sums=_at(spark, root, "sums", at["marks"]), **dimensions)


def write_marks(marks: DataFrame, path: str) -> None:
    """Whole periods, by borrower and loan.  Rebalancing keeps files few and splits a large period."""
    writer = marks.hint("rebalance", "period_end").sortWithinPartitions("period_end", "issuer_id", "loan_id").write.option("compression", "zstd")
    for column in ("loan_id", "issuer_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(LOANS_IN_A_GROUP))
    writer.partitionBy("period_end").parquet(path)


def load(spark: SparkSession, root: str, positions: DataFrame, rates: DataFrame, schedule_rows: DataFrame | None = None, *, new: bool = False, source: str = "bulk", scope: str = "", stream: tuple[str, int] | None = None) -> Frames:
    """Cleans positions (of :func:`as_filed`), puts them into the store at ``root`` and publishes the snapshot; ``new`` starts from nothing.

    Rows of printed schedules complete the positions before facilities are merged.  ``source`` and ``scope`` are for the run log.
    """
    started = datetime.now(UTC)
    if schedule_rows is not None:
        positions = enrich(positions, schedule_rows)
    return _load(spark, root, clean(positions, rates), started, new=new, source=source, scope=scope, stream=stream)


def load_merged(spark: SparkSession, root: str, merged: DataFrame, rates: DataFrame, *, new: bool = False, source: str = "bulk", scope: str = "") -> Frames:
    """:func:`load` of positions whose facilities are merged."""
    return _load(spark, root, clean_merged(merged, rates), datetime.now(UTC), new=new, source=source, scope=scope)


def _load(spark: SparkSession, root: str, cleaned: DataFrame, started: datetime, *, new: bool, source: str, scope: str, stream: tuple[str, int] | None = None) -> Frames:
    staged = shared_path(spark, "cleaned")
    cleaned.write.option("compression", "zstd").parquet(staged)
    return put(spark, root, spark.read.schema(cleaned.schema).parquet(staged), new=new, source=source, scope=scope, started=started.isoformat(timespec="seconds"), stream=stream)


def applied(spark: SparkSession, root: str, stream: str) -> int:
    """The last batch of a stream that the store holds, -1 for none."""
    last = _manifest(spark, root)
    return (last or {}).get("streams", {}).get(stream, -1)


def put(spark: SparkSession, root: str, cleaned: DataFrame, *, new: bool = False, source: str = "bulk", scope: str = "", started: str | None = None, stream: tuple[str, int] | None = None) -> Frames:
    """Cleaned positions of a stored table into the store, as one snapshot, which notes the batch of a stream that they are."""
    last = _manifest(spark, root)
    old = None if new else last
    load_id = uuid.uuid4().hex
    periods = {str(r.period_end): load_id for r in cleaned.select("period_end").distinct().collect()}
    made = marks_of(cleaned)
    if old is not None:
        touched = {day: load for day, load in old["marks"].items() if day in periods}
        if touched:
            before = _at(spark, root, "marks", touched)
            made = merged_marks(before, made.select(*before.columns))
    write_marks(made, f"{root}/marks/load={load_id}")
    for name, (derive, merge) in DIMENSIONS.items():
        rows = derive(cleaned)
        if old is not None:
            rows = merge(spark.read.parquet(f"{root}/{name}/load={old[name]}"), rows)
        rows.write.option("compression", "zstd").parquet(f"{root}/{name}/load={load_id}")
    sums = sums_of(_at(spark, root, "marks", periods), spark.read.parquet(f"{root}/loans/load={load_id}"))
    sums.hint("rebalance", "period_end").write.partitionBy("period_end").parquet(f"{root}/sums/load={load_id}")
    number = (last["snapshot"] if last else 0) + 1
    finished = datetime.now(UTC).isoformat(timespec="seconds")
    run = {"source": source, "scope": scope, "rows": cleaned.count(), "periods": len(periods), "started": started or finished, "finished": finished}
    manifest = {"snapshot": number, "load": load_id, "marks": (old["marks"] if old else {}) | periods, **dict.fromkeys(DIMENSIONS, load_id), "run": run, "streams": ((old or {}).get("streams") or {}) | (dict([stream]) if stream else {})}
    publish(spark, f"{root}/snapshots/{number:06d}.json", json.dumps(manifest, sort_keys=True))
    return open_store(spark, root, number)


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """One row for each published load: snapshot, source, scope, rows and periods it brought, start and finish."""
    run = "struct<source: string, scope: string, rows: long, periods: long, started: timestamp, finished: timestamp>"
    return spark.read.schema(f"snapshot long, run {run}").option("pathGlobFilter", "*.json").json(f"{root}/snapshots").select("snapshot", "run.*")


def expire(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Deletes what only snapshots before the last ``keep`` use, and files of lost loads; the deleted folders.

    Not while a load runs, whose files no manifest names yet.  Manifests stay, as they are the run log.
    """
    names = [n for n in names_in(spark, f"{root}/snapshots") if n.endswith(".json")][-keep:]
    kept = [json.loads(read_text(spark, f"{root}/snapshots/{n}")) for n in names]
    used = {f"{t}/load={load}/period_end={day}" for m in kept for day, load in m["marks"].items() for t in ("marks", "sums")} | {f"{t}/load={m[t]}" for m in kept for t in DIMENSIONS}
    there = [f"{t}/{n}" for t in DIMENSIONS for n in names_in(spark, f"{root}/{t}")]
    there += [f"{t}/{n}/{p}" for t in ("marks", "sums") for n in names_in(spark, f"{root}/{t}") for p in names_in(spark, f"{root}/{t}/{n}") if p.startswith("period_end=")]
    gone = [x for x in there if x not in used]
    for path in gone:
        delete(spark, f"{root}/{path}")
    return gone


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list ``bdcs`` of ticker, cik and name -> (cik, ticker, bdc_name); entries without cik are left out."""
    rows = spark.read.schema("bdcs array<struct<ticker: string, cik: long, name: string>>").json(path, multiLine=True)
    return rows.select(F.inline("bdcs")).where("cik IS NOT NULL").select("cik", "ticker", F.col("name").alias("bdc_name"))


#: Columns that cleaning needs and a source may lack.
FILED = {
    "principal_ccy": "string", "fair_value_ccy": "string", "year_acquired": "int", "year_matures": "int", "acquisition_date": "date",
    "shares": MONEY, "spread": "double", "pik_rate": "double", "pct_net_assets": "double",
}


def as_filed(positions: DataFrame, universe: DataFrame) -> DataFrame:
    """Positions of any source with their filer's names and all columns that cleaning needs; other filers' are left out."""
    missing = {c: F.lit(None).cast(t) for c, t in FILED.items() if c not in positions.columns}
    rows = positions.withColumns(missing | {"canonical_name": identity.canonical_issuer(F.col("issuer_name"))})
    return rows.drop("ticker", "bdc_name").join(universe, "cik").drop("tranche_text", "reference_rate")


_OPEN: dict[tuple[str, str], Frames] = {}


def lens_frames(spark: SparkSession, sf_dir: str) -> Frames:
    """The store of a data set, loaded on first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = load_merged(spark, shared_path(spark, "store"), lens.merged(spark, sf_dir), lens.rates(spark, sf_dir), new=True)
    return _OPEN[key]
