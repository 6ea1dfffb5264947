"""Repair of a conversation's turns by Dijkstra on the implicit (turn index, grammar state) lattice.

A repaired conversation's role initials read ``(s?(ua)+)?``: nothing, or user and assistant in turns, at most one system row
before them.  Edits and their costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant row
anywhere 3.  Blank and repeated rows must go; a truncated row that stays adds 3.

A node is (rows read, state of the grammar); edges are the edits, made when a node is popped, so the lattice is never
built.  Nodes are popped by (cost, audit), the audit being the initials of the edits so far, and the search ends with the first
accepting node behind the last row.  After any audit just one role can come next, but for a kept system row, so an audit tells
the repaired roles.

Long conversations are searched in blocks of ``BLOCK`` rows: a block starts from every node that the one before it reached by an edit
of its last row.  Audits up to there all edit the same rows and end with such an edit, so none begins with another
and their order outlasts whatever follows; a rank stands for them.  The result is that of one search, audits stay short and
memory is a few bytes for each row.

``repair`` shuffles narrow rows (no text) to find the audits, then rows and audits once more by conversation, and writes repaired
rows as they come; no conversation's texts are held.  Ahead of the audit a conversation's rows are counted in one task, with a
byte for each row and a digest for each distinct text.

Defined results.  Null roles and texts are one space.  Rows are taken by turn (null first), then role, then the text's SHA-256;
copies are alike.  A null conversation id is a conversation of its own.  A row's first fault counts: blank (no character but
ASCII white space), duplicate (its role and text came before), truncated (the last other character isn't ``.``, ``!`` or ``?``).
Texts of any length pass as they are.  An empty table gives no conversation.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: Initial that may be kept in a state, and the state behind it.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = ("su", "ua", "au")
BLOCK = 512
WHITE = " \t\n\x0b\x0c\r"
#: A row's code holds its initial (s, u, a or another) and what the search is to know of it.
CODES = [(initial, gone, cut) for initial in ("s", "u", "a", "") for gone in (False, True) for cut in (False, True)]
CODE_OF = {c: i for i, c in enumerate(CODES)}

AUDITS_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
AUDITS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
ROWS_DDL = "conv_id long, position long, edit string, role string, text string"
ROWS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
HASH_DDL = "conv_id long, repaired_sha256 string"
HASH = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
#: Characters and rows in one Arrow batch of repaired rows.
BATCH_CHARS, BATCH_ROWS = 1 << 24, 4096


def added(state: int) -> tuple[str, int]:
    """The role that an inserted or changed row takes in a state, and the state behind it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


@dataclass
class Reached:
    """A node that a block starts from: its cost, and its audit as the node of the block before and the letters since."""

    state: int
    cost: int
    before: Reached | None = None
    letters: str = ""

    def audit(self) -> str:
        parts, node = [], self
        while node is not None:
            parts.append(node.letters)
            node = node.before
        return "".join(reversed(parts))


def edges(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state: letter, cost, state behind it."""
    initial, gone, cut = CODES[code]
    yield "D", DELETE, state
    if not gone:
        more = TRUNCATED if cut else 0
        if (state, initial) in STEPS:
            yield "K", KEEP + more, STEPS[state, initial]
        yield "R", REROLE + more, added(state)[1]


def search(codes: bytes, entries: list[Reached], last: bool) -> list[Reached]:
    """Dijkstra over one block's rows from ``entries``, which are in the order of their audits.

    In the last block the first accepting node behind all rows ends the search and is returned alone; in others the best node
    of each state behind the block's last row is, in the order of audits, without inserts after that row.
    """
    n = len(codes)
    heap = [(e.cost, rank, "", 0, e.state) for rank, e in enumerate(entries)]
    heapify(heap)
    done, ends = set(), []
    while heap:
        cost, rank, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n:
            if not last:
                ends.append((rank, audit, Reached(state, cost, entries[rank], audit)))
                continue
            if state in ACCEPTING:
                return [Reached(state, cost, entries[rank], audit)]
        else:
            for letter, price, behind in edges(codes[at], state):
                heappush(heap, (cost + price, rank, audit + letter, at + 1, behind))
        heappush(heap, (cost + INSERT, rank, audit + "I", at, added(state)[1]))
    return [r for *_, r in sorted(ends, key=lambda e: e[:2])]


def best_edits(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows, the ASCII-least audit where several cost the same."""
    front, at = [Reached(START, 0)], 0
    while len(codes) - at > block:
        front, at = search(codes[at : at + block], front, False), at + block
    end = search(codes[at:], front, True)[0]
    return end.cost, end.audit()


@dataclass
class Conversation:
    """What one conversation's rows, read in order, leave: counts, and a byte for each row."""

    conv_id: int | None
    codes: bytearray = field(default_factory=bytearray)
    seen: set[bytes] = field(default_factory=set)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: int | None = None
    turn: int | None = None
    turns: int = 0
    initial: str | None = None

    def read(self, turn: int | None, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        repeated = not blank and digest in self.seen
        self.seen.add(digest)
        cut = cut and not repeated and not blank
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
        self.codes.append(CODE_OF[initial if initial in ("s", "u", "a") else "", blank or repeated, cut])

    def result(self, block: int) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *best_edits(bytes(self.codes), block))


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if chars > BATCH_CHARS or len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from (tuple(v.as_py() for v in row) for row in zip(*batch.columns, strict=True))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` picks, one in twenty each: dropped (``present`` is false), emptied,
    without sentence ends, repeated, or turned into the user's."""
    picked = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(picked == 4, "user").otherwise(role).alias("role"),
        F.when(picked == 1, "").when(picked == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (picked != 0).alias("present"),
        F.when(picked == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "digest")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(conv_id, turn, role, text, present) -> one row per conversation: gaps, counts of faults, cost and audit.

    Rows that aren't ``present`` only keep their conversation in the result.
    """
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    narrow = rows.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "present", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), "role", _digest().alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            conv = None
            for conv_id, turn, initial, present, blank, cut, _, digest in tuples(batches):
                if conv is None or conv.conv_id != conv_id:
                    if conv is not None:
                        yield conv.result(block)
                    conv = Conversation(conv_id)
                if present:
                    conv.read(turn, initial, blank, cut, digest)
            if conv is not None:
                yield conv.result(block)

        yield from batches_of(found(), AUDITS)

    return _ordered(narrow).mapInArrow(run, AUDITS_DDL)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of each conversation, its audit ahead of them -> (conv_id, position, edit, role, text) of the repaired one.

    Deleted rows come with a null position; a last row with an empty edit ends each conversation.
    """
    conv_id, audit, at, state, place, open_ = None, "", 0, START, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role, state = added(state)
            yield conv_id, place, "I", role, ""
            at, place = at + 1, place + 1

    for of, head, _, role, _, text, new_audit in tuples(batches):
        if head:
            if open_:
                yield from inserted()
                yield conv_id, None, "", "", ""
            conv_id, audit, at, state, place, open_ = of, new_audit, 0, START, 0, True
            continue
        yield from inserted()
        letter, at = audit[at], at + 1
        if letter == "D":
            yield conv_id, None, "D", role, text
            continue
        if letter == "R":
            role, state = added(state)
        else:
            state = STEPS[state, role[:1]]
        yield conv_id, place, letter, role, text
        place += 1
    if open_:
        yield from inserted()
        yield conv_id, None, "", "", ""


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    heads = found.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit")
    body = rows.where("present").select("conv_id", F.lit(False).alias("head"), "turn", "role", _digest().alias("digest"), "text", F.lit("").alias("audit"))
    return _ordered(heads.unionByName(body).withColumn("later", ~F.col("head")), "later").drop("later")


def repair(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text, present) -> (conv_id, position, edit, role, text): the repaired rows, numbered in each
    conversation, and the deleted ones without a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for row in _edited(batches) if row[2]), ROWS)

    return _with_audits(rows, audits(rows) if found is None else found).mapInArrow(run, ROWS_DDL)


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of each repaired conversation's ``role:text`` lines, fed row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            digest = hashlib.sha256()
            for conv_id, position, edit, role, text in _edited(batches):
                if position is not None:
                    digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                elif not edit:
                    yield conv_id, digest.hexdigest()
                    digest = hashlib.sha256()

        yield from batches_of(hashed(), HASH)

    return _with_audits(rows, found).mapInArrow(run, HASH_DDL)


def audited(rows: DataFrame) -> DataFrame:
    """:func:`audits` with the hash of each repaired conversation; the audits are stored between."""
    found = stored(audits(rows), "audits")
    hashes = repaired_hashes(rows, found)
    return found.join(hashes, found["conv_id"].eqNullSafe(hashes["conv_id"])).drop(hashes["conv_id"])
