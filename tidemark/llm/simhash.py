"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprint: words are runs without ASCII white space, A-Z lower-cased; every run of ``shingle`` words (the whole
sequence if shorter) is hashed with XXH64 (seed 42), and a bit is set where over half the hashes have it.  A text
without words has fingerprint zero and links like any other.

Links (at most ``max_bits`` = 3 different bits) between distinct fingerprints:

1.  Four 16-bit fields: two linked fingerprints agree in one field at least, so each goes to four buckets.  A bucket of
    more than ``hot_bucket`` members is replaced by finer ones: its members' other bits are cut into four fields again,
    of which linked ones share one.  This goes on to a fourth depth, where 43 bits agree and a bucket has at most
    2**21 members (16 MB).  Counts of hot buckets are joined to their members, never collected.
2.  A bucket is sorted by Gray rank and indexed (:class:`GrayIndex`): a node holds the bits that all its members
    share and its parent's don't, and a search adds up differences on its way down and drops a whole group when they
    exceed the limit, or when the group is already known to be linked to the one searched for.
3.  A bucket's answer is a forest (member, root), so no pair list of a dense group is made.  Forests are joined by
    alternating star contraction (:mod:`tidemark.llm.components`).

Copies share a fingerprint and meet in step 1 as one.

Defined results.  Null texts are empty.  Texts of any length are read whole, 65,536 shingles at a time.  Repeated rows come back repeated.  A null id never is a component's id
unless all its documents' are null.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread_join, stored, text_rows
from tidemark.llm.components import components

PRINTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])
FOREST = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of one text, unsigned."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    hashed, seed = xxhash.xxh64_intdigest, 42
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([hashed(x, seed) for x in runs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, row_col: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> (row, doc_id, fp); ``fp`` holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(x, shingle) for x in batch.column(2).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], schema=PRINTS)

    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    return text_rows(docs, number.alias("row")).select("row", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "row long, doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a word in the Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Search among distinct fingerprints, sorted by Gray rank, with ``fan`` members or nodes to a node.

    ``levels[0]`` are the fingerprints themselves; a level has the nodes' patterns and the mask of those shared
    bits that the parent hasn't counted.
    """

    def __init__(self, members: np.ndarray, fan: int = 16):
        self.members, self.fan = members[np.argsort(gray_rank(members), kind="stable")], fan
        patterns, shared = [self.members], [np.full(len(members), ~np.uint64(0))]
        while len(patterns[-1]) > 1:
            p, s = patterns[-1], shared[-1]
            starts = np.arange(0, len(p), fan)
            heads = np.repeat(p[starts], np.diff(np.append(starts, len(p))))
            common = np.bitwise_and.reduceat(s & ~(p ^ heads), starts)
            patterns.append(p[starts])
            shared.append(common)
        self.patterns = patterns
        self.own = [s & ~np.repeat(up, fan)[: len(s)] for s, up in zip(shared, shared[1:])] + [shared[-1]]

    def neighbours(self, queries: np.ndarray, limit: int, labels: np.ndarray | None = None, own_labels: np.ndarray | None = None):
        """(query number, member number) of all within ``limit`` bits; with labels, only of those labelled otherwise."""
        top = len(self.patterns) - 1
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        spent = np.bitwise_count((queries ^ self.patterns[top][0]) & self.own[top][0]).astype(np.int64)
        q, node, spent = q[spent <= limit], node[spent <= limit], spent[spent <= limit]
        uniform = self.uniform(labels) if labels is not None else None
        for level in range(top - 1, -1, -1):
            n = len(self.patterns[level])
            child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            q, spent = np.repeat(q, self.fan), np.repeat(spent, self.fan)
            real = child < n
            q, child, spent = q[real], child[real], spent[real]
            spent = spent + np.bitwise_count((queries[q] ^ self.patterns[level][child]) & self.own[level][child])
            near = spent <= limit
            if uniform is not None:
                near &= uniform[level][child] != own_labels[q]
            q, node, spent = q[near], child[near], spent[near]
        return q, node

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level, the label that all members of a node bear, else -1."""
        out = [labels]
        for p in self.patterns[1:]:
            starts = np.arange(0, len(out[-1]), self.fan)
            low, high = np.minimum.reduceat(out[-1], starts), np.maximum.reduceat(out[-1], starts)
            out.append(np.where(low == high, low, -1))
            assert len(out[-1]) == len(p)
        return out

    def roots(self, limit: int, block: int = 128) -> np.ndarray:
        """Per member, the smallest member number that it is linked to, over any number of links."""
        labels = np.arange(len(self.members))
        for at in range(0, len(self.members), block):
            q, m = self.neighbours(self.members[at : at + block], limit, labels, labels[at : at + block])
            a, b = q + at, m
            while len(a):
                la, lb = labels[a], labels[b]
                low, high = np.minimum(la, lb), np.maximum(la, lb)
                np.minimum.at(labels, high, low)
                while not np.array_equal(labels, labels[labels]):
                    labels = labels[labels]
                apart = labels[a] != labels[b]
                a, b = a[apart], b[apart]
        return labels


def _fields(mask: int) -> list[int]:
    """``mask`` with a quarter of the other bits added, for each quarter, from the lowest up."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // 4 for i in range(5)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(rows: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """(fp, mask) whose masks are among ``masks`` -> (fp, mask, value) of four finer buckets for each, and their masks."""
    finer = {m: _fields(m) for m in masks}
    table = F.create_map(*(x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(v)) for v in f)))))
    cut = rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
    return cut.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")), [v for f in finer.values() for v in f]


DEPTH = 4


def dealt_buckets(prints: DataFrame, hot_bucket: int) -> DataFrame:
    """(fp) -> (fp, mask, value): every two linked fingerprints share a bucket (mask, value)."""
    rows, masks = _buckets(prints.select("fp", F.lit(0).cast("long").alias("mask")), [0])
    done = []
    for _ in range(DEPTH - 1):
        hot = stored(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket), "hot-buckets")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, ["mask", "value"], "left_anti"))
        # A hot bucket has many rows by definition: those with the most are met where they lie.
        rows, masks = _buckets(stored(spread_join(rows, hot, ["mask", "value"], "n").select("fp", "mask"), "hot-members"), masks)
    return reduce(DataFrame.unionByName, [*done, rows])


def links(prints: DataFrame, max_bits: int = 3, hot_bucket: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> forest (a, b) whose components are those of all links."""
    if max_bits > 3:
        raise ValueError("four fields find links of three bits at most")
    dealt = dealt_buckets(prints, hot_bucket).select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def forest(parts: list[np.ndarray]):
        members = np.unique(np.concatenate(parts))  # two ways of cutting may end in one bucket
        if len(members) > 1:
            index = GrayIndex(members.view(np.uint64))
            root = index.roots(max_bits)
            other = np.flatnonzero(root != np.arange(len(root)))
            if len(other):
                values = index.members.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values[other]), pa.array(values[root[other]])], schema=FOREST)

    def pair(members: np.ndarray) -> bool:
        """Whether a small bucket has any link at all."""
        x = members.view(np.uint64)
        return int((np.bitwise_count(x[:, None] ^ x) <= max_bits).sum()) > len(x)

    def run(batches):
        last, held = None, []
        for batch in batches:
            mask, value, fp = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))) if len(fp) else []
            for at, to in zip(starts, [*starts[1:], len(fp)], strict=True):
                bucket = int(mask[at]), int(value[at])
                if bucket != last and held:
                    if sum(map(len, held)) > 64 or pair(np.concatenate(held)):
                        yield from forest(held)
                    held = []
                last = bucket
                held.append(fp[at:to])
        if held:
            yield from forest(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, *, shingle: int = 3, max_bits: int = 3, hot_bucket: int = 4096, row_col: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fingerprint, component_id, kept, row), one row per document.

    ``kept`` marks the first row of a component, by id (null last), then row.  ``row_col`` names a column of distinct
    longs that comes back as ``row``; without it rows are numbered here.
    """
    prints = stored(fingerprints(docs, shingle, row_col), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = stored(prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "nodes")
    forest = stored(links(nodes.select("fp"), max_bits, hot_bucket), "forest")
    linked = stored(components(forest).join(nodes.select("fp", "first"), F.col("node") == F.col("fp")).select("fp", "root", "first"), "linked")
    firsts = stored(linked.groupBy("root").agg(F.min("first").alias("group_first"), F.count("*").alias("members")), "firsts")
    grouped = spread_join(linked.select("fp", "root"), firsts, ["root"], "members").select("fp", "group_first")
    groups = stored(nodes.join(grouped, "fp", "left").select("fp", F.coalesce("group_first", "first").alias("first"), "n"), "grouped")
    out = spread_join(prints, groups, ["fp"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "row")
