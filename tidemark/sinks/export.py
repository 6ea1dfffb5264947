"""Small results to files: JSON for each view, one HTML page, and a workbook.

Views have at most some thousands of rows.  The marks themselves, which grow, are written by executors
(:func:`write_marks_csv`); a workbook's sheet takes them as a stream of partitions.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable
from datetime import date
from decimal import Decimal
from itertools import chain
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import views
from tidemark.plans.store import Frames

SHEET_ROWS = 1_048_576


def plain(value):
    """Dates as ISO text, decimals as numbers."""
    if isinstance(value, date):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value


def records(df: DataFrame) -> list[dict]:
    return [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def tickers(f: Frames) -> list[str]:
    return [r.ticker for r in f.bdcs.select("ticker").orderBy("ticker").collect()]


def bundle(f: Frames, period: str | None = None) -> dict:
    """Every view, the data set's description, and positions by filer."""
    out = {name: records(views.build(f, name, period)) for name in views.BUNDLE}
    out["meta"] = records(views.export_meta(f, period))[0]
    out["positions"] = {t: records(views.bdc_positions(f, period, t)) for t in tickers(f)}
    return out


def export_all(f: Frames, target: str, period: str | None = None) -> list[Path]:
    """One file for each view, ``positions/<ticker>.json`` and ``meta.json``."""
    root = Path(target)
    (root / "positions").mkdir(parents=True, exist_ok=True)
    every = bundle(f, period)
    parts = {f"positions/{t}.json": rows for t, rows in every.pop("positions").items()} | {f"{name}.json": value for name, value in every.items()}
    written = []
    for name, value in parts.items():
        (root / name).write_text(_json(value), encoding="utf-8")
        written.append(root / name)
    return written


PAGE = """<!doctype html><meta charset="utf-8"><title>Loan marks</title>
<style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;text-align:left}th{cursor:pointer}</style>
<h1>Loan marks</h1><p id="meta"></p><select id="view"></select><div id="out"></div>
<script>const data=__DATA__;
const pick=document.getElementById("view"),out=document.getElementById("out");
document.getElementById("meta").textContent=JSON.stringify(data.meta);
for(const name of Object.keys(data).filter(x=>Array.isArray(data[x]))){const o=document.createElement("option");o.textContent=name;pick.append(o)}
function show(rows,by,down){out.replaceChildren();if(!rows.length)return;const keys=Object.keys(rows[0]);
 if(by)rows=[...rows].sort((a,b)=>{a=a[by];b=b[by];if(a==null||b==null)return(a==null)-(b==null);return(a<b?-1:a>b?1:0)*(down?-1:1)});
 const t=document.createElement("table"),h=t.insertRow();
 for(const k of keys){const c=document.createElement("th");c.textContent=k;c.onclick=()=>show(rows,k,!(down&&by===k));h.append(c)}
 for(const r of rows.slice(0,500)){const tr=t.insertRow();for(const k of keys)tr.insertCell().textContent=r[k]??""}
 out.append(t)}
pick.onchange=()=>show(data[pick.value]);pick.onchange();</script>
"""


def write_html(f: Frames, path: str, period: str | None = None) -> int:
    """One page that holds its data; ``</`` can't end its script early.  Returns the number of bytes."""
    page = PAGE.replace("__DATA__", _json(bundle(f, period)).replace("</", "<\\/"))
    return Path(path).write_bytes(page.encode())


def column_name(number: int) -> str:
    """0 is A, 26 is AA."""
    name = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(row: int, column: int, value) -> str:
    at = f"{column_name(column)}{row}"
    value = plain(value)
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _workbook(path: str, sheets: list[tuple[str, list[str], Iterable]]) -> dict[str, int]:
    """Office Open XML with one part for each sheet; rows are written as they come."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    counts = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="s{i}"/>' for i, (n, *_) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (name, columns, rows) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                n = 0
                for n, row in enumerate(chain([columns], rows), 1):
                    if n > SHEET_ROWS:
                        raise ValueError(f"sheet {name!r} has more than {SHEET_ROWS} rows; write them as CSV")
                    out.write(f'<row r="{n}">{"".join(_cell(n, c, v) for c, v in enumerate(row))}</row>'.encode())
                out.write(b"</sheetData></worksheet>")
                counts[name] = n - 1
    return counts


def export_workbook(f: Frames, path: str, period: str | None = None, include_unpriced: bool = False) -> dict[str, int]:
    """Eight sheets; the period is the newest with a priced mark where none is given.  Returns rows for each sheet."""
    period = period or views.latest(f.marks.where("fair_value IS NOT NULL"))
    if period is None:
        raise ValueError("no marks to write")
    marks = views.marks_export(f, None, include_unpriced)

    def sheet(name: str, df: DataFrame):
        return name, df.columns, (tuple(r) for r in df.toLocalIterator())

    quarters = [r.quarter for r in views.latest_per_quarter(f).select("quarter").distinct().orderBy("quarter").collect()]

    def grid(name: str, df: DataFrame, value: str):
        return sheet(name, df.groupBy("ticker", "bdc_name").pivot("quarter", quarters).agg(F.first(value)).orderBy("ticker"))

    def year(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("Not disclosed")))

    cohorts = [views.vintage_profile(f).withColumnRenamed("vintage_year", "year"), views.maturity_profile(f, period).withColumnRenamed("maturity_year", "year")]
    both = year(cohorts[0], "year").withColumn("cohort", F.lit("vintage")).unionByName(year(cohorts[1], "year").withColumn("cohort", F.lit("maturity")))
    meta = records(views.export_meta(f, period))[0] | records(views.dataset_stats(f, period))[0]
    return _workbook(
        path,
        [
            ("Read me", ["item", "value"], list(meta.items())),
            sheet("BDC summary", views.bdc_sheet(f, period)),
            grid("Weighted marks", views.quarterly_bdc_marks(f), "weighted_mark"),
            grid("Non-accrual marks", views.quarterly_nonaccrual_marks(f), "weighted_mark"),
            grid("Non-accrual share", views.quarterly_nonaccrual_share(f), "nonaccrual_pct"),
            sheet("Vintage and maturity", both),
            sheet("Disagreements", views.disagreements(f, period, limit=1000)),
            sheet("Marks", marks),
        ],
    )


def write_marks_csv(f: Frames, path: str, include_unpriced: bool = False) -> None:
    """All marks as CSV, by executors."""
    views.marks_export(f, None, include_unpriced).write.mode("overwrite").option("header", True).csv(path)
