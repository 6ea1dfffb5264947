"""A corpus from documents to packed sequences, stage by stage.

A stage takes what the one before it kept.  Documents that score as toxic go; of exact copies one stays; of each
near-duplicate group one stays; documents that hold a benchmark passage go; the rest is packed into sequences, with
their ids.  Decisions are made for rows, not for ids, so rows with null or repeated ids have a fate of their own: the
two stages that compare documents number their rows in a stored table first.

Defined results.  Null texts are empty.  Texts of any length are read whole by every stage; the longest may be cut only in packing, where each id still lies
in one piece.  Repeated rows are copies, of which one stays.  Further columns, whatever their
names, come through to packing, which takes doc_id and text.  An empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, read, stored
from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.exact import exact_groups
from tidemark.llm.queries_packing import packed
from tidemark.llm.queries_toxicity import THRESHOLD, fitted
from tidemark.llm.simhash import near_groups
from tidemark.llm.toxicity import without_toxic


#: Fewer than packing holds by itself, and only while a task runs: its workers serve other stages before and after.
CACHED_WORDS = 150_000


def _kept(docs: DataFrame, groups: Callable[..., DataFrame]) -> DataFrame:
    row = free_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = groups(numbered, row_col=row).where("kept").select(F.col("row").alias(row))
    return numbered.join(rows, row, "left_semi").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fitted(docs, read(spark, sf_dir, "labels")), THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact_groups)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near is what op7's query says (3-word shingles, fingerprints within 3 bits), not a similarity of five-word shingles."""
    return _kept(docs, near_groups)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, ids=True, cached_words=CACHED_WORDS, keep_words=False)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: A fitted score, XXH64 fingerprints and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
