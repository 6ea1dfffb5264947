"""Whole filings, tagged facts and printed page, read in one pass that a bad filing doesn't end.

``read_filings`` goes through filings once.  What it can read of one comes out as facts and printed rows; where a part can't be read,
one row says which filing, which part and why.  All are staged in one write, split by kind, so that reading one kind touches nothing else and
no filing is parsed twice.

A filing whose facts can't be read gives nothing, as a page alone makes no position.  One whose page can't be read keeps its facts and goes without
what the page would have added.

Defined results.  Null facts are an error of their own (``NoFacts``), a null page has no row.  An empty table gives three empty ones.  Filings are
listed once; a repeated one comes twice.  Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.store import as_filed
from tidemark.sources import facts as tagged
from tidemark.sources import schedules
from tidemark.storage import shared_path

FACT = pa.struct(
    [("seq", pa.int64()), ("concept", pa.string()), ("period_type", pa.string()), ("period_instant", pa.string()), ("value", pa.string()), ("numeric_value", pa.float64()), ("currency", pa.string()), ("dims", pa.map_(pa.string(), pa.string()))]
)
PRINTED = pa.struct([("seq", pa.int64()), *((t, pa.string()) for t in schedules.TEXTS)])
ERROR = pa.struct([("part", pa.string()), ("cause", pa.string()), ("detail", pa.string())])
READ = pa.schema([("accession", pa.string()), ("fact", FACT), ("printed", PRINTED), ("error", ERROR), ("kind", pa.string())])
READ_DDL = (
    "accession string, fact struct<seq long, concept string, period_type string, period_instant string, value string, numeric_value double, currency string, dims map<string, string>>, "
    f"printed struct<seq long, {', '.join(t + ' string' for t in schedules.TEXTS)}>, error struct<part string, cause string, detail string>, kind string"
)
#: Rows in one Arrow batch.
BATCH_ROWS = 4096


class NoFacts(ValueError):
    """A filing without tagged facts."""


@dataclass
class Filings:
    facts: DataFrame
    printed: DataFrame
    errors: DataFrame


def facts_of(text: str | None) -> list[dict]:
    """Tagged facts of a filing's JSON list; anything else raises."""
    if text is None:
        raise NoFacts("no tagged facts")
    out = []
    for seq, fact in enumerate(json.loads(text)):
        number = fact.get("numeric_value")
        out.append(
            {
                "seq": seq,
                "concept": str(fact["concept"]),
                **{k: None if fact.get(k) is None else str(fact[k]) for k in ("period_type", "period_instant", "value", "currency")},
                "numeric_value": None if number is None else float(number),
                "dims": [(str(k), str(v)) for k, v in (fact.get("dims") or {}).items()],
            }
        )
    return out


def rows_of_filing(accession: str, facts: str | None, html: str | None) -> Iterator[dict]:
    part = "facts"
    try:
        read = facts_of(facts)
        yield from ({"accession": accession, "kind": "fact", "fact": f} for f in read)
        part = "page"
        yield from ({"accession": accession, "kind": "printed", "printed": {"seq": i, **row}} for i, row in enumerate(schedules.schedule_of(html or "")))
    except Exception as error:  # noqa: BLE001  any fault of one filing is its own
        yield {"accession": accession, "kind": "error", "error": {"part": part, "cause": type(error).__name__, "detail": str(error)[:500]}}


def read_filings(filings: DataFrame) -> Filings:
    """filings(accession, facts, html) -> facts, printed rows and errors, staged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for accession, facts, html in zip(*batch.columns, strict=True):
                for row in rows_of_filing(accession.as_py(), facts.as_py(), html.as_py()):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=READ)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=READ)

    spark = filings.sparkSession
    staged = shared_path(spark, "filings")
    filings.select("accession", "facts", "html").mapInArrow(run, READ_DDL).write.option("compression", "zstd").partitionBy("kind").parquet(staged)
    read = spark.read.schema(READ_DDL).parquet(staged)

    def of(kind: str) -> DataFrame:
        return read.where(F.col("kind") == kind).select("accession", f"{kind}.*")

    return Filings(of("fact"), schedules.printed_rows(of("printed")), of("error"))


def harvest(filings: DataFrame, universe: DataFrame, periods: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """filings(accession, cik, form, filed_date, facts, html) -> positions of the universe's filers, completed from the printed pages
    before facilities are merged, and the errors."""
    read = read_filings(filings)
    positions = tagged.to_positions(read.facts, filings, periods)
    return schedules.enrich(as_filed(positions, universe), read.printed), read.errors
