"""Fill-in-the-middle by a matcher that reads a text twice and stores no units.

The first pass counts the units of a text, the second advances a lazy iterator of matches to the two ranks that bound the
middle and takes the code points where these end.  So beside the text itself a document needs two numbers,
however many units it has.

Two cuts, the form and the order come from the SHA-256 of seed and id, so a document's output is the same in every run and on every machine.
psm writes prefix, suffix, middle; spm suffix, prefix, middle; each part behind its mark.  A text that holds a mark stays
plain, so an output can be split at its marks again (:func:`restore`): a mark begins with ``<`` and has it nowhere
else, and the character behind ``<`` decides, so no mark can arise where a part meets a mark.

Defined results.  A null text is empty; an empty one is plain.  A null id is hashed as an empty string.  Repeated rows come
back repeated.  Texts of any length are cut whole.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
OUT_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Characters of output in one Arrow batch, beside those of its last row.
BATCH_CHARS = 1 << 24


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def unit_ends(text: str, low: int, high: int) -> tuple[int, int]:
    """The code points at which the units of rank ``low`` and ``high`` end, ranks counted from 1; rank 0 ends at 0."""
    matches = UNIT.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def transformed(text: str, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    n = count_units(text)
    if not text or h3 % 100 >= fim_percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = h1 % (n + 1), h2 % (n + 1)
    start, end = unit_ends(text, min(a, b), max(a, b))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if h4 % 100 < spm_percent:
        return n, "spm", start, end - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, end - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output), one row per document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                rows.append((doc_id, *transformed(text, doc_id, seed, fim_percent, spm_percent)))
                held += len(text)
                if held > BATCH_CHARS:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return text_rows(docs).mapInArrow(run, OUT_DDL)


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone."""
    parts = F.split(output, "<[PSM]>")

    def text(*order: int) -> Column:
        return F.concat(*(F.get(parts, F.lit(i)) for i in order))

    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)
