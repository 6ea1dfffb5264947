"""Token ids in a content-addressed store.

A document's ids (its text's, then the end id) are cut where a rolling hash of the last ``WINDOW`` ids has nine zero
bits, so an edit moves only the cuts near it; chunks have ``SHORTEST`` to ``LONGEST`` ids.  A chunk's address is its
128-bit BLAKE2b digest.  The store is Parquet files under one path, with two kinds of rows:

* ``document``, in ascending id order within and over the files: a document's recipe (``chunks``: addresses,
  ``lengths``), its Merkle root, and the contents of the chunks that it is the first to hold.  ``place`` tells where a
  chunk's content is: 0 in this row's ``own``, 1 in this row's ``shared`` (other recipes use it too), 2 in the ``shared``
  of another row.  Each distinct chunk's content is in the store once.
* ``manifest``, last of each part: its number, documents, ids and the Merkle root over its documents' roots.

Writing encodes once: rows are staged, addresses alone are grouped to find repeated chunks (cells of very frequent
ones meet their mark where they lie), and one shuffle by id range brings rows and their marks together in order.  Reading moves no content but that of repeated chunks.  Each
chunk, each document's root and each file's root is checked.

Defined results.  Null and empty texts are the end id alone.  Null ids come first.  Rows that share an id are
documents of their own, in the order of the scan.  Texts of any length are cut into chunks; a document is one row, so its
ids are to fit a task's memory.  An empty table gives an empty store.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_path, salted_join, spread_join, stored, text_rows, work_path
from tidemark.llm.tokens import TokenizerFile

WINDOW, MASK, SHORTEST, LONGEST = 16, np.uint32(511), 128, 2048
STAGED = "row long, doc_id long, chunks array<binary>, lengths array<int>, content binary"
PACKED = "kind string, part int, seq long, doc_id long, n_tokens long, width int, chunks array<binary>, lengths array<int>, place array<int>, own binary, shared array<struct<address: binary, content: binary>>, root binary"
BYTES = pa.binary()
SHARED = pa.list_(pa.struct([("address", BYTES), ("content", BYTES)]))
STAGED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunks", pa.list_(BYTES)), ("lengths", pa.list_(pa.int32())), ("content", BYTES)])
PACKED_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("chunks", pa.list_(BYTES)), ("lengths", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("own", BYTES), ("shared", SHARED), ("root", BYTES)])
READ_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", BYTES)])
BATCH_BYTES = 4 << 20
#: Ids that are hashed in one step.
CUT_IDS = 1 << 18


def address(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


class Merkle:
    """Root over leaves given one by one; holds a digest for each level at most."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = hashlib.blake2b(b"\0" + leaf, digest_size=16).digest()
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = node
                return
            self.levels[i], node = None, hashlib.blake2b(b"\1" + left + node, digest_size=16).digest()
        self.levels.append(node)

    def root(self) -> bytes:
        node = b""
        for left in self.levels:
            if left is not None:
                node = hashlib.blake2b(b"\1" + left + node, digest_size=16).digest() if node else left
        return node


def merkle_root(leaves) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def marks(ids: np.ndarray) -> np.ndarray:
    """Places of an id sequence behind which the rolling hash lets a chunk end.

    Documents may follow each other in ``ids``: windows that reach into the one before end less than ``SHORTEST`` ids behind it, where no cut is.
    """
    # A window's hash, by doubling: each step joins two neighbouring halves.
    h = ids.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    k, factor = 1, np.uint32(2246822519)
    while k < WINDOW:
        joined = h.copy()
        joined[k:] += h[:-k] * factor
        h, k, factor = joined, 2 * k, np.uint32(int(factor) * int(factor) & 0xFFFFFFFF)
    return np.flatnonzero((h >> np.uint32(20)) & MASK == 0) + 1


def chunk_ends(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids with these marks."""
    if n <= SHORTEST:
        return [n]
    out, start = [], 0
    for end in places:
        while end - start > LONGEST:
            start += LONGEST
            out.append(start)
        if end - start >= SHORTEST:
            out.append(end)
            start = end
    while n - start > LONGEST:
        start += LONGEST
        out.append(start)
    return out + [n] if start < n else out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id sequence."""
    return chunk_ends(len(ids), marks(ids).tolist())


def _cut(docs: list[np.ndarray], end_id: int):
    """(ids with the end id, ends of its chunks) of each document; about ``CUT_IDS`` ids are hashed at a time."""
    end, at = np.array([end_id], "<u4"), 0
    sizes = np.cumsum([len(x) + 1 for x in docs])
    while at < len(docs):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + CUT_IDS, "right")))
        ids = np.concatenate([x for doc in docs[at:to] for x in (doc, end)])
        bounds = np.concatenate(([0], sizes[at:to] - base))
        places = marks(ids)
        # A mark right behind a document's last id is that document's.
        of = np.searchsorted(places, bounds, "right").tolist()
        bounds = bounds.tolist()
        for i in range(to - at):
            a, b = bounds[i], bounds[i + 1]
            yield ids[a:b], chunk_ends(b - a, (places[of[i] : of[i + 1]] - a).tolist())
        at = to


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _grouped(rows, schema: pa.Schema):
    """Record batches of about BATCH_BYTES from (size, row) pairs."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _stage(docs: DataFrame, tokenizer_path: str, unit: str, end_id: int, width: int) -> DataFrame:
    tokenizer = TokenizerFile(docs.sparkSession, tokenizer_path)

    def run(batches):
        encode, base = tokenizer.encoder(unit).encode, TaskContext.get().partitionId() << 33

        def rows():
            n = 0
            for batch in batches:
                for doc_id, (ids, ends) in zip(batch.column(0).to_pylist(), _cut(encode(batch.column(1)), end_id), strict=True):
                    content = ids.astype(f"<u{width}").tobytes()
                    starts = [0, *ends[:-1]]
                    chunks = [address(content[width * a : width * b]) for a, b in zip(starts, ends, strict=True)]
                    yield len(content) + 40 * len(chunks), (base + n, doc_id, chunks, [b - a for a, b in zip(starts, ends, strict=True)], content)
                    n += 1

        yield from _grouped(rows(), STAGED_ARROW)

    return text_rows(docs).mapInArrow(run, STAGED)


def _pack(staged: DataFrame, width: int) -> DataFrame:
    """Rows of the store; marks of repeated chunks come with their document's row."""
    cells = staged.select("row", "doc_id", F.posexplode("chunks").alias("pos", "chunk"))
    first = F.min(F.struct("doc_id", "row", "pos"))
    repeated = stored(cells.groupBy("chunk").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1"), "repeated")
    marked = spread_join(cells, repeated, ["chunk"], "n").select("row", "doc_id", "pos", ((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))).alias("owner"))
    marks = marked.groupBy("row", "doc_id").agg(F.collect_list(F.when(F.col("owner"), F.col("pos"))).alias("owned"), F.collect_list(F.when(~F.col("owner"), F.col("pos"))).alias("elsewhere"))
    nothing = {"owned": "array<int>", "elsewhere": "array<int>"}
    both = staged.select("row", "doc_id", F.lit(1).alias("order"), "chunks", "lengths", "content", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    both = both.unionByName(marks.select("row", "doc_id", F.lit(0).alias("order"), F.lit(None).cast("array<binary>").alias("chunks"), F.lit(None).cast("array<int>").alias("lengths"), F.lit(None).cast("binary").alias("content"), "owned", "elsewhere"))
    dealt = both.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row", "order")

    def run(batches):
        part = TaskContext.get().partitionId()

        def rows():
            seq = ids = 0
            tree, last, owned, elsewhere = Merkle(), None, set(), set()
            for batch in batches:
                for row, doc_id, order, chunks, lengths, content, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if order == 0:
                        last, owned, elsewhere = row, set(own), set(other)
                        continue
                    if row != last:
                        owned, elsewhere = set(), set()
                    place, kept, shared = [0] * len(chunks), content, []
                    if owned or elsewhere:
                        place = [1 if i in owned else 2 if i in elsewhere else 0 for i in range(len(chunks))]
                        at, pieces = 0, []
                        for chunk, n, where in zip(chunks, lengths, place, strict=True):
                            piece = content[at : at + width * n]
                            at += width * n
                            if where == 0:
                                pieces.append(piece)
                            elif where == 1:
                                shared.append({"address": chunk, "content": piece})
                        kept = b"".join(pieces)
                    root, n = merkle_root(chunks), sum(lengths)
                    tree.add(root)
                    yield len(content) + 100, ("document", part, seq, doc_id, n, width, chunks, lengths, place, kept, shared, root)
                    seq, ids = seq + 1, ids + n
            if seq:
                yield 100, ("manifest", part, seq, None, ids, width, None, None, None, None, None, tree.root())

        yield from _grouped(rows(), PACKED_ARROW)

    return dealt.mapInArrow(run, PACKED)


def _fetched(wanted: DataFrame, shared: DataFrame) -> DataFrame:
    """(part, seq, address) with the content of their chunks (address, content), one for each address.

    Empty texts all have one chunk, and boilerplate has few.  Chunks that over a thousandth of the wanted places name are fewer than
    ``HOT_KEYS``; their places are split into parts, each of which gets the content (:func:`tidemark.llm.common.salted_join`).
    """
    counts = stored(wanted.groupBy("address").agg(F.count("*").alias("n")), "chunk-counts")
    return salted_join(wanted, shared, "address", counts)


class Store:
    """A written store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = spark.read.schema(PACKED).parquet(path)
        self.documents = self.table.where("kind = 'document'").drop("kind")
        self.manifests = self.table.where("kind = 'manifest'").select("part", F.col("seq").alias("n_docs"), F.col("n_tokens").alias("n_ids"), "root")

    def check_manifests(self) -> None:
        """Raises if a file's documents, ids or Merkle root aren't those of its manifest."""

        def run(batches):
            part, tree, n, ids = None, Merkle(), 0, 0
            out = []
            for batch in batches:
                for p, root, tokens in zip(*(batch.column(c).to_pylist() for c in ("part", "root", "n_tokens")), strict=True):
                    if p != part:
                        if part is not None:
                            out.append((part, n, ids, tree.root()))
                        part, tree, n, ids = p, Merkle(), 0, 0
                    tree.add(root)
                    n, ids = n + 1, ids + tokens
            if part is not None:
                out.append((part, n, ids, tree.root()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), BYTES), strict=True)], names=["part", "n_docs", "n_ids", "root"])

        found = self.documents.select("part", "seq", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "seq").mapInArrow(run, "part int, n_docs long, n_ids long, root binary")
        wrong = found.unionByName(self.manifests).groupBy("part", "n_docs", "n_ids", "root").count().where("count <> 2")
        if bad := wrong.take(1):
            raise ValueError(f"file {bad[0].part} is not as its manifest says")

    def read(self) -> DataFrame:
        """(part, seq, doc_id, n_tokens, ids): each document's ids as little-endian unsigned 32-bit."""

        def run(batches):
            def rows():
                for batch in batches:
                    found = batch.column("fetched").to_pylist() if "fetched" in batch.schema.names else [None] * len(batch)
                    columns = [batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "n_tokens", "width", "chunks", "lengths", "place", "own", "shared", "root")]
                    for part, seq, doc_id, n_tokens, width, chunks, lengths, places, own, shared, root, fetched in zip(*columns, found, strict=True):
                        content = {x["address"]: x["content"] for x in (shared or []) + (fetched or [])}
                        at, pieces = 0, []
                        for chunk, n, place in zip(chunks, lengths, places, strict=True):
                            piece = content.get(chunk, b"") if place else own[at : at + n * width]
                            at += 0 if place else n * width
                            if address(piece) != chunk or len(piece) != n * width:
                                raise ValueError(f"document {doc_id}: a chunk is not what its address says")
                            pieces.append(piece)
                        if merkle_root(chunks) != root:
                            raise ValueError(f"document {doc_id}: its recipe is not what its root says")
                        ids = np.frombuffer(b"".join(pieces), f"<u{width}").astype("<u4").tobytes()
                        yield len(ids), (part, seq, doc_id, n_tokens, ids)

            yield from _grouped(rows(), READ_ARROW)

        elsewhere = F.exists("place", lambda p: p == 2)
        whole = self.documents.where(~elsewhere).mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids binary")
        wanted = self.documents.where(elsewhere).select("part", "seq", F.explode(F.array_distinct(F.filter(F.arrays_zip("chunks", "place"), lambda x: x["place"] == 2))).alias("c")).select("part", "seq", F.col("c.chunks").alias("address"))
        shared = self.documents.where(F.size("shared") > 0).select(F.explode("shared").alias("s")).select("s.address", "s.content")
        fetched = _fetched(wanted, shared).groupBy("part", "seq").agg(F.collect_list(F.struct("address", "content")).alias("fetched"))
        rest = self.documents.where(elsewhere).join(fetched, ["part", "seq"]).mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids binary")
        return whole.unionByName(rest)

    def starts(self) -> DataFrame:
        """(part, part_start): ids before each file."""
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return self.manifests.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))


def write(docs: DataFrame, tokenizer_path: str, path: str, *, unit: str = "word", end_id: int = 1) -> Store:
    """documents(doc_id, text) -> the store at ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    staging = work_path(spark, "ids")
    _stage(docs, tokenizer_path, unit, end_id, width).write.option("compression", "zstd").parquet(staging)
    _pack(spark.read.schema(STAGED).parquet(staging), width).write.option("compression", "zstd").parquet(path)
    drop_path(spark, staging)
    return Store(spark, path)
