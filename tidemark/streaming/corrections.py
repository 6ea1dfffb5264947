"""Late corrections as a stream: an extension, since the tables themselves come in releases.

A file stream watches a landing folder.  It carries files' paths alone; each micro-batch's files are read by their own headings
(:func:`tidemark.sources.tables.landing_positions`), cleaned and put into the store as one snapshot, which notes stream and batch.  Structured
Streaming may hand a batch over again after a failure; a batch that the store has is left out, so each is applied once, and a
batch that was lost before its snapshot was published has changed nothing.

A batch without position tables (a release's submissions, say) is noted nowhere and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans import store
from tidemark.sources import tables

FILES = "path string, modificationTime timestamp, length long, content binary"


def apply_batch(spark: SparkSession, root: str, universe: DataFrame, rates: DataFrame, files: list[str], stream: str, batch: int) -> bool:
    """One batch's files into the store; whether it was applied, which it isn't twice."""
    if batch <= store.applied(spark, root, stream):
        return False
    try:
        positions = tables.landing_positions(spark, files)
    except tables.NoTables:
        return False
    store.load(spark, root, store.as_filed(positions, universe), rates, source="stream", scope=f"{stream}:{batch}", stream=(stream, batch))
    return True


def corrections(spark: SparkSession, landing: str, root: str, universe: DataFrame, rates: DataFrame, checkpoint: str, *, name: str = "corrections", files_a_batch: int = 1000) -> StreamingQuery:
    """Starts the stream over what lies in ``landing`` and isn't read yet; it ends when that is done.

    ``checkpoint`` remembers the files that were read, and belongs to one ``name``.  Schedule it again for later files.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r.path for r in batch.select("path").collect())
        if files:
            apply_batch(batch.sparkSession, root, universe, rates, files, name, batch_id)

    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(landing).select("path")
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
