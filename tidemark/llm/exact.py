"""Exact duplicates by deterministic block naming.

A text without its ASCII white space is cut into blocks of ``block_bytes``.  Blocks are dealt out by their hash, so that
equal ones meet, and sorted within a task; equal blocks get one integer name: the task's number and the block's rank in
it.  Then pairs of adjacent names are named in the same way, level by level, until each document has one name.
Documents with equally many blocks and the same name are equal: names stand for contents, not for hashes of them, so
nothing collides.

A task remembers the blocks it has dealt; when they exceed ``SEEN_BYTES`` it keeps those met again since it last
forgot, the most frequent first and up to half of that, so a hot block is dealt about once a task and not once for
each document: documents refer to such blocks by number.  Hot pairs and hot documents are counted first and met where their rows lie
(:func:`tidemark.llm.common.spread_join`).

Defined results.  A null text is empty; empty texts form one group.  Of equal texts the row with the most code
points in the original text stays, then the smallest id (null last), then the first row of the scan, so of repeated
rows just one stays.  Texts of any length work: a level halves the names.  An empty table gives no row.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread_join, stored, text_rows

SPACE = b" \t\n\x0b\x0c\r"
SEEN_BYTES = 1 << 24
CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("points", pa.int64()), ("text_sha256", pa.string()), ("blocks", pa.list_(pa.int64())), ("fresh", pa.list_(pa.struct([("block", pa.int64()), ("content", pa.binary())])))])
CUT_DDL = "row long, doc_id long, points long, text_sha256 string, blocks array<long>, fresh array<struct<block long, content binary>>"
NAMED = pa.schema([("block", pa.int64()), ("name", pa.int64())])


class Dealt:
    """Numbers of the blocks that a task has dealt lately."""

    def __init__(self, base: int, limit: int):
        self.next, self.limit, self.held = base, limit, 0
        self.numbers: dict[bytes, int] = {}
        self.again: Counter[bytes] = Counter()

    def number(self, content: bytes) -> tuple[int, bool]:
        """The block's number, and whether it is a new one."""
        known = self.numbers.get(content)
        if known is not None:
            self.again[content] += 1
            return known, False
        if self.held > self.limit:
            self._forget()
        number = self.numbers[content] = self.next
        self.next += 1
        self.held += len(content) + 100
        return number, True

    def _forget(self) -> None:
        kept, self.held = {}, 0
        for content, _ in self.again.most_common():
            if self.held + len(content) + 100 > self.limit // 2:
                break
            kept[content] = self.numbers[content]
            self.held += len(content) + 100
        self.numbers = kept
        self.again.clear()


def cut_blocks(docs: DataFrame, block_bytes: int, row_col: str | None = None) -> DataFrame:
    """One row per document: its blocks' numbers, and the content of those that its task hasn't seen lately."""

    def run(batches):
        dealt = Dealt(TaskContext.get().partitionId() << 33, SEEN_BYTES)
        for batch in batches:
            out = []
            for row, doc_id, text, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bare = text.translate(None, SPACE)
                own, fresh = [], []
                for at in range(0, max(len(bare), 1), block_bytes):
                    content = bare[at : at + block_bytes]
                    number, new = dealt.number(content)
                    if new:
                        fresh.append({"block": number, "content": content})
                    own.append(number)
                out.append((row, doc_id, points, hashlib.sha256(bare).hexdigest(), own, fresh))
                if len(out) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CUT, strict=True)], schema=CUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CUT, strict=True)], schema=CUT)

    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = text_rows(docs, number.alias("row")).select("row", "doc_id", F.col("text").cast("binary").alias("text"), F.char_length("text").cast("long").alias("points"))
    return rows.mapInArrow(run, CUT_DDL)


def name_blocks(fresh: DataFrame) -> DataFrame:
    """(block, content) -> (block, name): equal contents get one integer."""

    def run(batches):
        base, rank, last = TaskContext.get().partitionId() << 33, -1, None
        for batch in batches:
            names = []
            for content in batch.column(1).to_pylist():
                if content != last:
                    rank, last = rank + 1, content
                names.append(base + rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], schema=NAMED)

    return fresh.select("block", "content").repartition("content").sortWithinPartitions("content").mapInArrow(run, "block long, name long")


def identities(cut: DataFrame) -> DataFrame:
    """Rows of :func:`cut_blocks` -> (row, n_blocks, name): equal exactly where the texts are."""
    names = name_blocks(cut.select(F.explode("fresh").alias("f")).select("f.block", "f.content"))
    cells = cut.select("row", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    cells = stored(cells.join(names, "block").select("row", "n_blocks", F.col("pos").cast("long").alias("pos"), "name"), "names-0")
    done, most, level = cells.where("n_blocks = 1"), cells.agg(F.max("n_blocks")).first()[0] or 1, 1
    open_cells = cells.where("n_blocks > 1")
    while 2 ** (level - 1) < most:
        # An odd last name is paired with -1.
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = open_cells.groupBy("row", "n_blocks", F.floor(F.col("pos") / 2).alias("pos")).agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right"))
        pairs = stored(pairs, f"pairs-{level}")
        # Each pair once, sorted within its task: the task's number and the rank in it are its name.
        named = pairs.groupBy("left", "right").agg(F.count("*").alias("n")).sortWithinPartitions("left", "right")
        named = stored(named.withColumn("name", F.monotonically_increasing_id()), f"pair-names-{level}")
        cells = stored(spread_join(pairs, named, ["left", "right"], "n").select("row", "n_blocks", "pos", "name"), f"names-{level}")
        finished = F.col("n_blocks") <= 2**level
        done = done.unionByName(cells.where(finished))
        open_cells, level = cells.where(~finished), level + 1
    return done.select("row", "n_blocks", "name")


def exact_groups(docs: DataFrame, block_bytes: int = 1 << 11, row_col: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, keep_id, group_size, kept, text_sha256, row), one row per document.

    ``row_col`` names a column of distinct longs that comes back as ``row``; without it rows are numbered here.
    """
    cut = stored(cut_blocks(docs, block_bytes, row_col), "blocks")
    rows = stored(cut.select("row", "doc_id", "points", "text_sha256").join(identities(cut), "row"), "identities")
    best = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = rows.groupBy("n_blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    groups = stored(groups.select("n_blocks", "name", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    return spread_join(rows, groups, ["n_blocks", "name"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row")
