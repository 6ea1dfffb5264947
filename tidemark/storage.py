"""Where tables go that outlive a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that is unset, a local session gets a temporary folder of this machine; any other one raises, since its
    executors couldn't see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no such folder."""
    where, files = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    where, files = _place(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed.  An existing one stays, and raises."""
    where, files = _place(spark, path)
    waiting, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(waiting)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.exists(where) or not files.rename(waiting, where):
        files.delete(waiting, False)
        raise FileExistsError(path)
