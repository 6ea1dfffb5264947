"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import shared_path as work_path

#: A key with more than one in so many rows is hot; there are fewer hot keys than this.
HOT_KEYS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and an executor's loss costs nothing."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, of which each key has one row that counts the key's rows in ``n``.

    Keys that hold over a thousandth of the counted rows, so fewer than ``HOT_KEYS`` of them, meet their rows by
    broadcast, where these lie; the others by shuffle.  So no key's rows gather in one task.  Keys aren't null.  Both
    sides are read more than once and are to be stored tables or cheap.
    """
    limit = (facts.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS
    hot = facts.where(F.col(n) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(facts.where(F.col(n) <= limit), keys, how))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined with ``facts`` by shuffle, where ``counts`` (key, n) tells how many rows a key has.

    Keys with over a thousandth of the counted rows, so fewer than ``HOT_KEYS`` of them, are split into parts by a hash
    of the whole row, and their facts repeated for each part; the parts of all keys are fewer than twice ``HOT_KEYS``.
    A key may have several facts.
    """
    limit = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    part, parts = free_name(rows, "part"), free_name(rows, "parts")
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias(parts)))
    share = F.coalesce(F.col(parts), F.lit(1))
    split = rows.join(hot, key, "left").withColumn(part, F.pmod(F.xxhash64(*rows.columns), share)).drop(parts)
    repeated = facts.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), share - 1))).drop(parts)
    return split.join(repeated, [key, part]).drop(part)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores put after it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of :func:`work_path` through the store's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Only the two columns an operator reads, and ``more``; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def keep_rows(docs: DataFrame, wanted: Callable[[str], bool], text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, whose text (null: empty) is wanted."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([wanted(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
