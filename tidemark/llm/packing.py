"""Packing by minimum bin slack.

A document's ids (its text's, then the end id) are cut at every ``capacity`` ids; full pieces are sequences of their
own.  The remaining pieces of a task wait in a window of ``window`` pieces, as counts of each length.  A sequence
starts with the longest waiting piece; a subset-sum over the other lengths, with bit sets whose bit i says that i
ids can be reached, finds the counts that fill it closest to the capacity.  Backtracking gives the count of each
length.  The same choice is taken as often as the counts allow.  Only what is left in a task's last window can
leave slack, so padding falls with the size of a task, and no row is shuffled.

A sequence's id is its task's number times 2**32 plus its number in the task: unique, not gapless over tasks.  A
sequence is to be padded to ``capacity`` unless its fill is a power of two (``padded_length``).

Defined results.  Null and empty texts are the end id alone.  Null ids and repeated rows are documents like any
other.  Documents of any length are cut, never dropped.  Equal lengths are taken last in, first out.  An empty
table gives no piece.  Other columns are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import text_rows
from tidemark.llm.tokens import TokenizerFile

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())])
BATCH_BYTES = 4 << 20


def choose(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many pieces of each length the next sequence takes; ``lengths`` are those with a count, ascending."""
    first = lengths[-1]
    need = capacity - first
    full, reach, steps = (1 << (need + 1)) - 1, 1, []
    for at in range(bisect_right(lengths, need) - 1, -1, -1):
        length = lengths[at]
        left, k = min(counts[length] - (length == first), need // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            k *= 2
        if reach >> need:
            break
    used, fill = defaultdict(int, {first: 1}), reach.bit_length() - 1
    for length, k, before in reversed(steps):
        if not before >> fill & 1:
            used[length] += k
            fill -= length * k
    return used


class Window:
    """Waiting pieces of one task."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.lengths, self.size = capacity, {}, [], 0

    def add(self, piece: tuple, length: int) -> None:
        if length not in self.by_length:
            self.by_length[length] = []
            self.lengths.insert(bisect_right(self.lengths, length), length)
        self.by_length[length].append(piece)
        self.size += 1

    def take(self, down_to: int):
        """Sequences (lists of pieces) until ``down_to`` pieces wait."""
        while self.size > down_to:
            counts = {k: len(v) for k, v in self.by_length.items()}
            used = choose(counts, self.lengths, self.capacity)
            for _ in range(min(counts[k] // n for k, n in used.items())):
                yield [self.by_length[k].pop() for k, n in sorted(used.items(), reverse=True) for _ in range(n)]
                self.size -= sum(used.values())
                if self.size <= down_to:
                    break
            for k in used:
                if not self.by_length[k]:
                    del self.by_length[k]
                    self.lengths.remove(k)


def padded(fill: int, capacity: int) -> int:
    return fill if fill & (fill - 1) == 0 else capacity


def pack(docs: DataFrame, tokenizer_path: str, *, unit: str = "space", end_id: int = 0, capacity: int = 1024, window: int = 16384, cached_words: int = 700_000, keep_words: bool = True) -> DataFrame:
    """documents(doc_id, text) -> pieces: see ``PIECES``; ``ids`` are little-endian unsigned 32-bit.

    A worker holds the ids of ``cached_words`` words, or twice as many; fewer take less memory and more time.  Without
    ``keep_words`` they go when a task ends, so that the worker is as small as before for what runs next.
    """

    tokenizer = TokenizerFile(docs.sparkSession, tokenizer_path)

    def run(batches):
        encode, waiting = tokenizer.encoder(unit, cached_words, keep_words).encode, Window(capacity)
        base, end = TaskContext.get().partitionId() << 32, array("I", [end_id]).tobytes()
        sequences, rows, held = 0, [], 0

        def placed(sequence):
            nonlocal sequences, held
            offset, fill = 0, sum(len(p[2]) // 4 for p in sequence)
            for doc_id, start, ids, total in sequence:
                rows.append((doc_id, start, len(ids) // 4, ids, total, base + sequences, offset, padded(fill, capacity)))
                offset += len(ids) // 4
                held += len(ids) + 64
            sequences += 1

        def out():
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = ids.tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = (doc_id, start, ids[4 * start : 4 * (start + capacity)], total)
                    if total - start >= capacity:
                        placed([piece])
                    else:
                        waiting.add(piece, total - start)
                    if held >= BATCH_BYTES:
                        yield out()
                if waiting.size > window:
                    for sequence in waiting.take(window // 2):
                        placed(sequence)
                        if held >= BATCH_BYTES:
                            yield out()
        for sequence in waiting.take(0):
            placed(sequence)
            if held >= BATCH_BYTES:
                yield out()
        if rows:
            yield out()

    return text_rows(docs).mapInArrow(run, PIECES)
