"""WARC archives as seekable Zstandard bundles.

Writing.  A task appends records to a frame until it holds
``frame_bytes``, compresses each frame on its own, and closes a bundle at ``bundle_bytes`` with a seek table: a
skippable frame with each frame's compressed and full size, in the Zstandard seekable format, so any Zstandard
reader can also read a bundle from its start.  The index maps each record to (bundle, frame, offset in the frame,
length).

Bundles are written through Arrow's file systems into the shared folder.  A task gives each bundle a name of its
own and the index names only bundles of tasks that ended well, so a task that ran twice leaves a file that nothing
refers to.

Reading.  Index rows are dealt by bundle; a reader loads a bundle's seek table, then only the frames asked for.

Records.  A response's block is an HTTP head and the payload, a revisit's the HTTP head alone.  Every record has an id of its
own, also where rows are equal; a revisit names what it refers to by its URI and ``X-Refers-To-Page``.

Revisits.  Among payloads of at least ``revisit_bytes`` that are equal (SHA-256), the record with the largest id is the
response and the others refer to it.  Digests that occur more than once set bits of a filter, broadcast as at most
``FILTER_WORDS`` words of 64 bits.  Smaller payloads, those that the filter tells to be unique and those with very
many copies stay in the tasks that scan them; only payloads with some copies (and the few that the filter lets
through) are shuffled by digest.  A filter too small for the repeated digests lets more through and loses none.

Defined results.  A null payload is empty.  Rows that repeat the largest id of a group are all responses.  A null id
counts as smaller than any; a group with null ids alone has responses only.  Null urls are written empty.  Payloads of
any length are one record each, held whole by the task that writes or reads it.  An empty table writes no bundle.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_KEYS, stored, work_path

# Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = "record_id string, page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"
#: Most words of the filter of repeated digests; it is built with so few that one in about sixteen bits is set.
FILTER_WORDS = 1 << 21
DATE = "1970-01-01T00:00:00Z"


def one_line(value: str) -> str:
    """A header value: percent signs, line ends and other control characters written as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def plain(value: str) -> str:
    head, *rest = value.split("%")
    return head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)


def record(own: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_uri: str) -> bytes:
    """A record's bytes; revisits carry no payload but its digest and size."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {one_line(refers_uri)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """A record's header, the payload's length as its HTTP head says, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not first.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, int(http.rpartition(b"Content-Length: ")[2]), payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class BundleWriter:
    """One bundle at a time; ``rows`` are index rows of the open one."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open = None

    def add(self, own_id: str, page_id: int | None, raw: bytes) -> list[tuple] | None:
        """Index rows of a bundle that this record completed."""
        if self.open is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.open, self.rows, self.frames, self.frame, self.size = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None), [], [], bytearray(), 0
        self.rows.append((own_id, page_id, self.name, len(self.frames), len(self.frame), len(raw)))
        self.frame += raw
        if len(self.frame) >= self.frame_bytes:
            self.flush()
        return self.close() if self.size >= self.bundle_bytes else None

    def flush(self) -> None:
        packed = self.press.compress(bytes(self.frame))
        self.open.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.size += len(packed)
        self.frame = bytearray()

    def close(self) -> list[tuple]:
        if self.open is None:
            return []
        if self.frame:
            self.flush()
        self.open.write(seek_table(self.frames))
        self.open.close()
        self.open = None
        return self.rows


class BundleReader:
    """Frames of a bundle by number; the last one is kept."""

    def __init__(self, folder: str):
        import zstandard

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.press, self.name, self.at = zstandard.ZstdDecompressor(), None, None

    def frame(self, name: str, number: int) -> bytes:
        if name != self.name:
            self.name, self.at, self.file = name, None, self.files.open_input_file(f"{self.folder}/{name}")
            size = self.file.size()
            n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
            if magic != SEEKABLE:
                raise ValueError(f"{name} has no seek table")
            table = self.file.read_at(8 * n, size - 9 - 8 * n)
            self.frames, at = [], 0
            for packed, full in struct.iter_unpack("<II", table):
                self.frames.append((at, packed, full))
                at += packed
        if number != self.at:
            at, packed, full = self.frames[number]
            self.content, self.at = self.press.decompress(self.file.read_at(packed, at)), number
            if len(self.content) != full:
                raise ValueError(f"{name}: frame {number} is not as long as its seek table says")
        return self.content


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 4096):
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def filter_bit(whole: Column, words: int) -> tuple[Column, Column]:
    """A digest's word of the filter, and its bit there."""
    number = F.xxhash64(whole)
    return F.pmod(F.shiftright(number, 6), F.lit(words)), F.pmod(number, F.lit(64)).cast("int")


def parted(hashed: DataFrame, groups: DataFrame, most_words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows that stay where they are scanned, with (newest, uri) of their group if it is a hot one, and those to be shuffled."""
    repeated, copies = groups.agg(F.count("*"), F.sum("n")).first()
    words = max(1, min(most_words, repeated // 4))
    word, bit = filter_bit(F.col("whole"), words)
    bits = groups.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    limit = (copies or 0) // HOT_KEYS
    hot = groups.where(F.col("n") > limit).select("whole", "newest", "uri", F.lit(True).alias("hot"))
    told = hashed.withColumn("word", word).join(F.broadcast(bits), "word", "left").join(F.broadcast(hot), "whole", "left")
    moves = F.col("whole").isNotNull() & F.coalesce(F.getbit("bits", bit) == 1, F.lit(False)) & F.col("hot").isNull()
    return told.where(~moves).select(*hashed.columns, "newest", "uri"), told.where(moves).select(*hashed.columns)


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3) -> DataFrame:
    """pages(page_id, url, html) -> the index (see ``INDEX``) of bundles written into ``folder``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashed = rows.withColumn("whole", F.when(F.octet_length("payload") >= revisit_bytes, F.sha2("payload", 256)))
    newest = F.max(F.struct("page_id", "url")).alias("newest")
    groups = stored(hashed.where("whole IS NOT NULL").groupBy("whole").agg(newest, F.count("*").alias("n")).where("n > 1").select("whole", F.col("newest.page_id").alias("newest"), F.col("newest.url").alias("uri"), "n"), "warc-groups")
    at_home, moved = parted(hashed, groups)
    refers = F.when((F.col("page_id") < F.col("newest")) | (F.col("page_id").isNull() & F.col("newest").isNotNull()), F.col("newest"))
    told = at_home.unionByName(moved.join(groups.select("whole", "newest", "uri"), "whole", "left")).select("page_id", "url", "payload", refers.alias("refers_to"), "uri")

    def run(batches):
        writer, part, n = BundleWriter(folder, frame_bytes, bundle_bytes, level), TaskContext.get().partitionId(), 0
        for batch in batches:
            for page_id, url, payload, refers_to, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.sha1(payload).hexdigest()
                own, n = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {part} {n}')}>", n + 1
                yield from _batches(writer.add(own, page_id, record(own, page_id, url, payload, digest, refers_to, uri)) or [], INDEX)
        yield from _batches(writer.close(), INDEX)

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return stored(told.mapInArrow(run, INDEX_DDL), "warc-index")


def read(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """Rows of an index -> records read from the bundles; each response's payload is checked against its digest."""

    def run(batches):
        reader = BundleReader(folder)
        for batch in batches:
            out, held = [], 0
            for own, _, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields, size, payload = parse(reader.frame(bundle, frame)[offset : offset + length])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Record-ID"] != own or fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"{bundle} does not hold record {own} as it was written")
                page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                out.append((own, int(page) if page else None, plain(fields["WARC-Target-URI"]), fields["WARC-Type"], digest, int(refers) if refers else None, size, payload if payloads else None))
                held += len(payload) * payloads
                if held > 1 << 24:
                    yield from _batches(out, RECORD)
                    out, held = [], 0
            yield from _batches(out, RECORD)

    dealt = index.select(*INDEX.names).repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(run, RECORD_DDL)


def bundle_folder(spark: SparkSession) -> str:
    """A new folder for bundles in the shared folder."""
    path = work_path(spark, "warc")
    return path if "://" in path else f"file://{path.removeprefix('file:')}"
