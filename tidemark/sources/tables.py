"""Bulk position tables: tab-separated text, read as text, with headings that drift from release to release.

A landing folder holds the tables of several releases.  Its files are grouped by their heading line and each group is scanned with
the columns of its own line, so a column that moved, was renamed or was added is read where that file has it
(:func:`landing_positions`).  Headings are resolved on the driver over the column names alone.  Archives can be read as they are
(:func:`archive_positions`).
"""

from __future__ import annotations

import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import coerce
from tidemark.operators.finalize import finalize
from tidemark.storage import shared_path

# Headings by name.
HEADINGS = {
    "identifier": ["Investment, Identifier Axis"],
    "issuer_name": ["Investment, Issuer Name Axis"],
    "investment_type_text": ["Investment Type Axis"],
    "industry": ["Industry Sector Axis"],
    "lien_text": ["Lien Category Axis"],
    "country": ["Geographical Axis", "Investment, Geographical Area Axis", "Country Axis"],
    "fair_value": ["Investment Owned, Fair Value", "Investment Owned, at Fair Value"],
    "cost": ["Investment Owned, Cost", "Investment Owned, at Cost"],
    "principal": ["Investment Owned, Balance, Principal Amount"],
    "shares": ["Investment Owned, Balance, Shares"],
    "interest_rate": ["Investment Interest Rate"],
    "spread": ["Investment, Basis Spread, Variable Rate"],
    "pik_rate": ["Investment, Interest Rate, Paid in Kind"],
    "maturity_date": ["Investment Maturity Date"],
    "acquisition_date": ["Investment, Acquisition Date"],
    "pct_net_assets": ["Investment Owned, Net Assets, Percentage"],
}
# What a heading is about, where its name is unknown; the first match wins.
SUBJECTS = [
    ("fair_value", r"fair\s*value", True),
    ("cost", r"\bcost\b", True),
    ("principal", r"principal", True),
    ("maturity_date", r"maturity", False),
    ("acquisition_date", r"acqui(?:sition|red)", False),
    ("pik_rate", r"paid[\s-]*in[\s-]*kind|\bpik\b", False),
    ("spread", r"spread", False),
    ("interest_rate", r"interest\s*rate", False),
    ("industry", r"industry|sector", False),
    ("country", r"geograph|country", False),
    ("issuer_name", r"issuer", False),
]
NOT_MONEY = r"level|hierarchy|technique|axis|percent"
PLAIN = {"adsh": "accession", "cik": "cik", "name": "filer", "form": "form", "filed": "filed_date", "ddate": "period_end"}


def resolve(columns: list[str]) -> dict[str, list[str]]:
    """Field -> the columns that hold it, by name first and by subject only where no name is known."""
    low = {c.lower().strip(): c for c in columns}
    found = {field: [low[h.lower()] for h in names if h.lower() in low] for field, names in HEADINGS.items()}
    found = {k: v for k, v in found.items() if v}
    taken = {c for v in found.values() for c in v} | {c for c in columns if c.lower() in PLAIN}
    for field, subject, is_money in SUBJECTS:
        if field not in found:
            for c in columns:
                if c not in taken and re.search(subject, c, re.I) and not (is_money and re.search(NOT_MONEY, c, re.I)):
                    found[field] = [c]
                    taken.add(c)
                    break
    return found


def tidy(text: Column) -> Column:
    """A cell without its " [Member]" tag; blank is null."""
    return F.nullif(coerce.stripped(F.replace(text, F.lit(" [Member]"), F.lit(""))), F.lit(""))


def to_positions(table: DataFrame, ciks: list[int] | None = None, source: str = "dera") -> DataFrame:
    """Rows of a bulk table -> positions; rows without filer or period are dropped."""
    where = resolve(table.columns)
    cell = lambda c: tidy(F.col(f"`{c}`"))
    value = {field: F.coalesce(*map(cell, columns)) for field, columns in where.items()}
    get = lambda field: value.get(field, F.lit(None).cast("string"))
    plain = {new: cell(c) for c in table.columns if (new := PLAIN.get(c.lower()))}
    label = coerce.joined(get("issuer_name"), get("investment_type_text"), get("lien_text"), get("identifier"))
    rows = table.select(
        plain["cik"].try_cast("long").alias("cik"),
        coerce.to_date(plain["period_end"]).alias("period_end"),
        *(plain.get(c, F.lit(None).cast("string")).alias(c) for c in ("accession", "form")),
        coerce.to_date(plain.get("filed_date", F.lit(None).cast("string"))).alias("filed_date"),
        get("identifier").alias("identifier"),
        get("issuer_name").alias("issuer_name"),
        coerce.joined(get("investment_type_text"), get("lien_text"), get("identifier")).alias("tranche_text"),
        get("industry").alias("industry"),
        get("country").alias("country"),
        *(coerce.to_decimal(get(c)).alias(c) for c in ("fair_value", "cost", "principal", "shares")),
        *(coerce.to_rate_pct(get(c)).alias(c) for c in ("interest_rate", "spread", "pik_rate", "pct_net_assets")),
        coerce.to_date(get("maturity_date")).alias("maturity_date"),
        coerce.to_date(get("acquisition_date")).alias("acquisition_date"),
        coerce.non_accrual(label).alias("is_non_accrual"),
        F.lit(source).alias("source"),
        F.monotonically_increasing_id().alias("seq"),
        F.array().cast("array<string>").alias("flags"),
    ).where("cik IS NOT NULL AND period_end IS NOT NULL")
    return finalize(rows.where(F.col("cik").isin(ciks)) if ciks is not None else rows)


class NoTables(ValueError):
    """No position table where some were looked for."""


def heading_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First line of each file that isn't empty, through the file system that holds it and its compression.

    One short read for each file, as listing has; threads, since each waits for the store.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(file: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream, codec = path.getFileSystem(conf).open(path), codecs.getCodec(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    with ThreadPoolExecutor(16) as pool:
        return {f: line for f, line in zip(files, pool.map(first, files), strict=True) if line}


def column_names(heading: str) -> list[str]:
    """Columns of a heading line; a repeated or blank heading gets a name of its own."""
    names: list[str] = []
    for i, name in enumerate(heading.removeprefix("\ufeff").rstrip("\r\n").split("\t")):
        name = name.strip() or f"column {i}"
        while name.lower() in {n.lower() for n in names}:
            name += "_"
        names.append(name)
    return names


def holds_positions(names: list[str]) -> bool:
    """Whether a table has a filer and a period; a release's other tables (submissions, say) haven't both."""
    return {"cik", "ddate"} <= {n.lower() for n in names}


def landing(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """Position tables of a folder and those below it, or of files, one for each heading line, all columns as text."""
    files = spark.read.option("recursiveFileLookup", True).text(path).inputFiles()
    groups: dict[str, list[str]] = defaultdict(list)
    for file, heading in sorted(heading_lines(spark, files).items()):
        groups[heading].append(unquote(file))
    found = []
    for heading, own in groups.items():
        names = column_names(heading)
        if holds_positions(names):
            schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
            found.append(spark.read.schema(schema).csv(own, sep="\t", header=True, quote=""))
    if not found:
        raise NoTables(f"no table with cik and ddate under {path}")
    return found


def united(parts: list[DataFrame], ciks: list[int] | None, source: str) -> DataFrame:
    """Positions of tables with different columns; ``seq`` stays distinct."""
    made = [to_positions(p, ciks, source).withColumn("seq", F.col("seq") * len(parts) + k) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, made)


def landing_positions(spark: SparkSession, path: str | list[str], ciks: list[int] | None = None, source: str = "dera") -> DataFrame:
    """Positions of all tables in a landing folder, whatever headings each has."""
    return united(landing(spark, path), ciks, source)


def read_archives(spark: SparkSession, path: str, members: tuple[str, ...] = ("soi.tsv", "soi.txt")) -> DataFrame:
    """Archive files -> (archive, heading, line): a member's lines below its heading, whichever folder of the archive holds it.

    An archive can't be read in parts, so each is one row of a binary scan and its lines come from one task, some
    megabytes at a time.
    """

    def lines(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    inside = {x.replace("\\", "/").rpartition("/")[2]: x for x in archive.namelist()}
                    member = next((inside[m] for m in members if m in inside), None)
                    if member is None:
                        continue
                    with archive.open(member) as file:
                        text = io.TextIOWrapper(file, encoding="utf-8", errors="replace", newline="\n")
                        heading = text.readline().rstrip("\r\n")
                        while part := text.readlines(1 << 22):
                            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array([heading] * len(part)), pa.array([x.rstrip("\r\n") for x in part])], names=["archive", "heading", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "archive string, heading string, line string")


def archive_positions(spark: SparkSession, path: str, ciks: list[int] | None = None, source: str = "dera") -> DataFrame:
    """Positions of all archives at a path; unpacked once, then read by heading as a landing folder is."""
    unpacked = shared_path(spark, "unpacked")
    read_archives(spark, path).where("line <> ''").write.option("compression", "zstd").partitionBy("heading").parquet(unpacked)
    rows = spark.read.schema("archive string, line string, heading string").parquet(unpacked)
    parts = []
    for (heading,) in rows.select("heading").distinct().orderBy("heading").collect():
        names = column_names(heading)
        if holds_positions(names):
            cells = F.split("line", "\t", -1)
            parts.append(rows.where(F.col("heading") == heading).select(*(F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names))))
    if not parts:
        raise NoTables(f"no table with cik and ddate in the archives of {path}")
    return united(parts, ciks, source)


def missing_quarters(wanted: DataFrame, published: DataFrame) -> DataFrame:
    return wanted.join(published, "quarter", "left_anti")


def quarters_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Quarter labels from "2024Q1" to "2025-Q3", both included; a hyphen is allowed."""

    def first(label: str) -> Column:
        year, _, quarter = label.upper().replace("-", "").partition("Q")
        return F.make_date(F.lit(int(year)), F.lit(int(quarter) * 3 - 2), F.lit(1))

    days = spark.range(1).select(F.explode(F.sequence(first(start), first(end), F.expr("interval 3 months"))).alias("d"))
    return days.select(F.concat(F.year("d"), F.lit("Q"), F.quarter("d")).alias("quarter"))


def latest_published_quarter(today: Column) -> Column:
    """The calendar quarter before a day."""
    day = F.add_months(F.trunc(today, "quarter"), -3)
    return F.concat(F.year(day), F.lit("Q"), F.quarter(day))
