"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment of words.

1.  Words are runs of letters and digits, lower-cased.  Items' ``n``-word seeds (an item with fewer words is its own
    seed) go into a bit filter of at most ``2 ** filter_bits`` bits, which is all that is broadcast.  One scan of the
    corpus puts down the seeds' places and the words around them, as far as an item with the seed could reach: the
    longest item of the seed's bucket, one of 65,536, tells how far.  A filter too small for a benchmark lets more
    places through, and fuller buckets make the pieces longer; neither changes a result.
2.  Seeds are counted over all places.  Rare are an item's seeds at no more than ``rare`` times as many places as the
    median of those that any document holds, the others are common.
3.  Places join items by seed, by shuffle.  A seed of more than ``crowd`` items doesn't pair each of its places with
    all of them: an alignment that reaches ``min_score`` matches at least that share of the item's words, so among any
    as many words as the rest has, and one more, is one that the place has near it.  Taken are those that the fewest
    items of the seed have, and places and items of such a seed meet by seed and word.  Items so short that the seed
    alone reaches ``min_score`` meet by the seed, as each meeting is a result.
4.  The stretches of a document around the places that the item could cover join the item's words and the document's,
    and each is aligned with the item:
    ``match`` for an equal word, minus ``mismatch`` for another word and minus ``gap`` for a missing or added one.
    Seeds of one stretch are aligned once.  A stretch with common seeds only is passed over where it holds too few of
    the item's words, in any order, for ``min_score``; so rarity saves time and no result depends on it.  The score is
    the best local alignment's over that of the item with itself; a pair is reported from ``min_score`` on, with the
    words that the alignment covers.

Alignment looks at an item's length on both sides of a seed, and half as much again for words that were added.
Texts of any length are read whole.  Seeds, items and documents with many places are split over tasks by a salt.

Short items: two texts that share no seed are never compared, so an item whose every run of ``n`` words was edited
is not found.

Defined results.  Null texts are empty and match nothing; items without words match nothing.  A repeated document
row gives repeated results; a repeated item is one item, and items with one id but other texts are joined to the
best of their scores, a null id being one id too.  Of equally good places the first counts.  An empty table gives no row.  Other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import free_name, salted_join, stored, text_rows

WORD = re.compile(r"\w+")
FOUND = "row long, doc_id long, item_id long, score double, start_word long, end_word long"
OPTIONS = {"n": 5, "rare": 2.0, "min_score": 0.5, "match": 2.0, "mismatch": 1.0, "gap": 1.0, "filter_bits": 30, "crowd": 16}
Seed = tuple[str, ...]

#: Odd factors that mix word hashes to a seed's and a seed's to its bits in the filter.
STEP, PROBES = np.uint64(0x9E3779B97F4A7C15), [np.uint64(x) for x in (1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Bits of the filter for each seed, bits of its smallest form and of the parts in which it comes to the driver.
BITS_PER_SEED, LEAST_BITS, CHUNK_BITS = 64, 20, 19
#: Words whose hashes a worker keeps.
KEPT_WORDS = 300_000
#: Bits of a seed that name its bucket of reach.
REACH_BITS = 16


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def seeds_of(words: list[str], n: int) -> list[Seed]:
    return list(zip(*(words[i:] for i in range(n)))) if len(words) >= n else [tuple(words)] * bool(words)


def align(text: np.ndarray, item: np.ndarray, match: float, mismatch: float, gap: float) -> tuple[float, int, int]:
    """Smith-Waterman over word numbers: best score, and the text's start and end (exclusive).

    One row of the matrix is one step: what comes from the left is a running maximum of scores less their gaps.  Of
    equally good alignments that with the smallest start counts, then that with the smallest end; none begins with
    words that add nothing to its score.
    """
    n = len(text)
    score, start = np.zeros(n + 1), np.arange(n + 1)
    at = np.arange(n + 1)
    slope = gap * at
    best = (0.0, 0, 0)
    for word in item:
        hit = np.where(text == word, match, -mismatch)
        up, diagonal = score[1:] - gap, score[:-1] + hit
        row = np.concatenate(([0.0], np.maximum(diagonal, up)))
        begun = np.concatenate(([0], np.minimum(np.where(diagonal >= up, start[:-1], n), np.where(up >= diagonal, start[1:], n))))
        row[row <= 0] = 0.0
        begun[row == 0] = at[row == 0]
        lifted = row + slope
        running = np.maximum.accumulate(lifted)
        # The least start among those that the running maximum comes from; a new maximum begins anew.
        level = (n + 2) * np.cumsum(np.concatenate(([0], running[1:] > running[:-1])))
        begun = np.minimum.accumulate(np.where(lifted == running, begun, n + 1) - level) + level
        row = running - slope
        begun[row <= 0] = at[row <= 0]
        top = row.max()
        if top > 0 and top >= best[0]:
            where = np.flatnonzero(row == top)
            first = where[begun[where].argmin()]
            found = (float(top), int(begun[first]), int(first))
            if top > best[0] or found[1:] < best[1:]:
                best = found
        score, start = row, begun
    return best


class WordHashes(dict):
    """XXH64 of words, kept for the commonest part of a corpus."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def seed_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` words, from the words' numbers."""
    runs = len(hashes) - n + 1
    if runs < 1:
        return np.zeros(0, np.uint64)
    total = np.full(runs, n, np.uint64)
    for i in range(n):
        total = total * STEP + hashes[i : i + runs]
    return total


def _bits(seeds: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
    return (seeds * probe) >> np.uint64(64 - bits)


class Filter:
    """Which numbers may be in a set."""

    def __init__(self, parts: list[tuple[int, bytes]], bits: int):
        self.parts, self.bits, self.held = parts, bits, None

    def passing(self, numbers: np.ndarray) -> np.ndarray:
        """Where the numbers that pass are."""
        if self.held is None:
            self.held = np.zeros(1 << (self.bits - 3), np.uint8)
            while self.parts:
                chunk, held = self.parts.pop()
                self.held[chunk << (CHUNK_BITS - 3) : (chunk + 1) << (CHUNK_BITS - 3)] = np.frombuffer(held, np.uint8)
        at = np.arange(len(numbers))
        for probe in PROBES:
            bit = _bits(numbers[at], probe, self.bits)
            at = at[(self.held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return at


class Seeds(NamedTuple):
    """What a scan knows of the items' seeds: a filter, their lengths, and how long items of each bucket are."""

    filter: Filter
    lengths: list[int]
    reach: np.ndarray

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of a text's word hashes that pass, and where they begin."""
        found, where = [], []
        for n in self.lengths:
            seeds = seed_hashes(hashes, n)
            at = self.filter.passing(seeds)
            found.append(seeds[at])
            where.append(at)
        return np.concatenate(found), np.concatenate(where)

    def pieces(self, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Stretches (start, end) of a text that hold all that items of their seeds could cover, with seeds and places."""
        seeds, at = self.places(hashes)
        long = self.reach[seeds >> np.uint64(64 - REACH_BITS)]
        around = long + long // 2 + 1
        low, high = np.maximum(at - around, 0), np.minimum(at + around, len(hashes))
        order = np.lexsort((high, low))
        seeds, at, low, high = seeds[order].view(np.int64), at[order], low[order], np.maximum.accumulate(high[order])
        begins = np.flatnonzero(low[1:] > high[:-1]) + 1
        for first, last in pairwise([0, *begins.tolist(), len(at)] if len(at) else []):
            start = int(low[first])
            yield start, int(high[last - 1]), seeds[first:last], at[first:last] - start


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["item_id", "item_words"])


def _item_seeds(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for item, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seeds = seed_hashes(hashes.of(words), min(n, len(words))).view(np.int64)
            columns = [np.full(len(seeds), item), np.full(len(seeds), len(words)), np.arange(len(seeds)), seeds]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "length", "i", "seed"])


def _seed_bits(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seeds = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.concatenate([_bits(seeds, probe, bits) for probe in PROBES]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> CHUNK_BITS), pa.array(at & ((1 << CHUNK_BITS) - 1))], names=["chunk", "bit"])


def _chunk(table: pa.Table) -> pa.Table:
    held = np.zeros(1 << CHUNK_BITS, np.uint8)
    held[table.column("bit").to_numpy()] = 1
    return pa.table({"chunk": table.column("chunk")[:1], "held": pa.array([np.packbits(held, bitorder="little").tobytes()])})


def _filter_of(numbers: DataFrame, most_bits: int) -> Filter:
    """Of one column of numbers."""
    distinct = numbers.distinct()
    bits = min(most_bits, max(LEAST_BITS, (distinct.count() * BITS_PER_SEED - 1).bit_length()))
    parts = distinct.mapInArrow(partial(_seed_bits, bits), "chunk long, bit long").groupBy("chunk").applyInArrow(_chunk, "chunk long, held binary")
    return Filter([(r.chunk, bytes(r.held)) for r in parts.collect()], bits)


def _reach_of(seeds: DataFrame) -> np.ndarray:
    reach = np.zeros(1 << REACH_BITS, np.int64)
    for r in seeds.groupBy(F.shiftrightunsigned("seed", 64 - REACH_BITS).alias("bucket")).agg(F.max("length").alias("length")).collect():
        reach[r.bucket] = r.length
    return reach


def _placed(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        out = []
        for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            out += [(row, doc_id, start, words[start:end], seeds, at) for start, end, seeds, at in shared.value.pieces(hashes.of(words))]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "start", "words", "seeds", "at"])


def _with_seed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A number for each word beside a seed."""
    return (hashes ^ np.array([seed]).view(np.uint64)) * STEP + hashes


def _item_meetings(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item, i, ..., item_words) -> a row for each word outside the seed, as the number of word and seed."""
    hashes = WordHashes()
    for batch in batches:
        for seed, item, i, length, rare, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            met = _with_seed(hashes.of(words[:i] + words[i + n :]), seed).view(np.int64)
            columns = [met, *(np.full(len(met), x) for x in (item, i, length, rare))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["met", "item", "i", "length", "rare"])


def _place_meetings(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, places, words) -> the numbers of seed and word at each place that some item may have."""
    hashes = WordHashes()
    for batch in batches:
        for piece, places, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            numbers = hashes.of(words)
            for place in places:
                around = place["reach"] + place["reach"] // 2 + 1
                met = _with_seed(np.unique(numbers[max(0, place["at"] - around) : place["at"] + around]), place["seed"])
                met = met[shared.value.passing(met)].view(np.int64)
                columns = [np.full(len(met), piece), np.full(len(met), place["at"]), met]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["piece", "at", "met"])


def _aligned(options: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches (row, doc_id, item_id, passage, item_words, a, rare) that reach the least score."""
    least, weights = options["min_score"], [options[k] for k in ("match", "mismatch", "gap")]
    for batch in batches:
        out = []
        for row, doc_id, item_id, passage, item, a, rare in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not rare and _held(passage, item) / len(item) < least - 1e-9:
                continue
            number = {w: x for x, w in enumerate(dict.fromkeys(item))}
            score, start, end = align(np.array([number.get(w, -1) for w in passage]), np.array([number[w] for w in item]), *weights)
            score /= options["match"] * len(item)
            if score >= least:
                out.append((row, doc_id, item_id, score, a + start, a + end))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "doc_id", "item_id", "score", "start_word", "end_word"])


def _known(seeds: DataFrame, held: DataFrame, rare: float) -> DataFrame:
    """(seed, item, i, length, items, rare): seeds that documents hold, how many items have each, and whether it is rare for the item."""
    per_seed = seeds.groupBy("seed").agg(F.count("*").alias("n"))
    facts = held.withColumnRenamed("n", "places").join(per_seed.withColumnRenamed("n", "items"), "seed")
    known = salted_join(seeds, facts, "seed", per_seed)
    counts = known.groupBy("item").agg(F.sort_array(F.collect_list("places")).alias("places"))
    median = counts.select("item", F.get("places", F.floor(F.size("places") / 2).cast("int")).alias("median"))
    return known.join(median, "item").select("seed", "item", "i", "length", "items", (F.col("places") <= rare * F.col("median")).alias("rare"))


def _crowd_met(hit: DataFrame, places: DataFrame, crowded: DataFrame, items: DataFrame, held: DataFrame, options: dict) -> DataFrame:
    """(piece, at, item, i, length, rare): places of crowded seeds with the items that could reach the least score there."""
    columns = ["item", "i", "length", "rare"]
    beside = crowded.select("seed", *columns).join(items.select("item", "item_words"), "item").select("seed", *columns, "item_words")
    beside = stored(beside.mapInArrow(partial(_item_meetings, options["n"]), "met long, item long, i long, length long, rare boolean"), "crowd-words")
    counts = stored(beside.groupBy("met").agg(F.count("*").alias("n")), "crowd-counts")
    fewest = Window.partitionBy("item", "i").orderBy("n", "met")
    enough = F.col("length") - F.ceil(F.col("length") * options["min_score"] - 1e-9) + 1
    ranked = salted_join(beside, counts, "met", counts).withColumn("rank", F.row_number().over(fewest))
    taken = stored(ranked.where(F.col("rank") <= enough).select("met", *columns).distinct(), "crowd-taken")

    shared = hit.sparkSession.sparkContext.broadcast(_filter_of(taken.select(F.col("met").alias("seed")), options["filter_bits"]))
    reach = crowded.groupBy("seed").agg(F.max("length").alias("reach"))
    near = salted_join(places, reach, "seed", held).groupBy("piece").agg(F.collect_list(F.struct("seed", "at", "reach")).alias("places"))
    words = near.join(hit.select("piece", "words"), "piece").select("piece", "places", "words")
    met = stored(words.mapInArrow(partial(_place_meetings, shared), "piece long, at long, met long"), "crowd-met")
    shared.destroy()
    return salted_join(met, taken, "met", met.groupBy("met").agg(F.count("*").alias("n"))).select("piece", "at", *columns).distinct()


def _stretches(hit: DataFrame, seeds: DataFrame, items: DataFrame, options: dict) -> DataFrame:
    """(piece, item, a, b, rare): where items could lie in pieces of documents, overlapping stretches as one."""
    held = hit.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    held = stored(held.join(seeds.select("seed"), "seed", "left_semi"), "held")
    places = hit.select("piece", F.explode(F.arrays_zip("seeds", "at")).alias("p")).select("piece", F.col("p.seeds").alias("seed"), F.col("p.at").alias("at"))
    places = places.join(held.select("seed"), "seed", "left_semi")
    known = stored(_known(seeds, held, options["rare"]), "known")
    in_crowd = (F.col("items") > options["crowd"]) & (F.ceil(F.col("length") * options["min_score"] - 1e-9) > options["n"])
    columns = ["piece", "at", "item", "i", "length", "rare"]
    met = salted_join(places, known.where(~in_crowd), "seed", held).select(columns)
    if not known.where(in_crowd).isEmpty():
        met = met.unionByName(_crowd_met(hit, places, known.where(in_crowd), items, held, options))
    half = F.floor(F.col("length") / 2)
    # The item's words before and after the seed, and half as many again for words added.
    around = met.select(
        "piece", "item", "rare", F.greatest(F.lit(0), F.col("at") - F.col("i") - half - 1).alias("a"), (F.col("at") + F.col("length") - F.col("i") + half + 1).alias("b")
    )
    of_pair = Window.partitionBy("piece", "item").orderBy("a", "b")
    reached = F.max("b").over(of_pair.rowsBetween(Window.unboundedPreceding, -1))
    begins = around.withColumn("begins", F.coalesce((F.col("a") > reached).cast("int"), F.lit(1)))
    islands = begins.withColumn("island", F.sum("begins").over(of_pair.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("piece", "item", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("rare").alias("rare")).drop("island")


def _leaks(docs: DataFrame, bench: DataFrame, id_col: str, options: dict) -> DataFrame | None:
    """(row, doc_id, item_id, score, start_word, end_word) for documents(row, doc_id, text); None without items."""
    texts = bench.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    items = texts.mapInArrow(_item_words, "item_id long, item_words array<string>").where(F.size("item_words") > 0)
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stored(items.select("item", "item_words").mapInArrow(partial(_item_seeds, options["n"]), "item long, length long, i long, seed long"), "item-seeds")
    lengths = sorted(r.n for r in items.select(F.least(F.size("item_words"), F.lit(options["n"])).alias("n")).distinct().collect())
    if not lengths:
        return None
    known = Seeds(_filter_of(seeds.select("seed"), options["filter_bits"]), lengths, _reach_of(seeds))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    hit = docs.select("row", "doc_id", "text").mapInArrow(partial(_placed, shared), "row long, doc_id long, start long, words array<string>, seeds array<long>, at array<long>")
    hit = stored(hit.withColumn("piece", F.monotonically_increasing_id()), "placed")
    shared.destroy()

    stretches = stored(_stretches(hit, seeds, items, options), "stretches")
    of_items = salted_join(stretches, items, "item", stretches.groupBy("item").agg(F.count("*").alias("n")))
    pieces = hit.select("piece", "row", "doc_id", "start", "words")
    both = salted_join(of_items, pieces, "piece", stretches.groupBy("piece").agg(F.count("*").alias("n")))
    passage = F.slice("words", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")).alias("passage")
    passages = both.select("row", "doc_id", "item_id", passage, "item_words", (F.col("start") + F.col("a")).alias("a"), "rare")
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("best")
    return passages.mapInArrow(partial(_aligned, options), FOUND).groupBy("row", "doc_id", "item_id").agg(best).select("row", "doc_id", "item_id", "best.*")


def leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "item_id", **changed) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, score, start_word, end_word).

    ``changed``: of ``OPTIONS``.
    """
    found = _leaks(text_rows(docs, F.monotonically_increasing_id().alias("row")), bench, id_col, OPTIONS | changed)
    return docs.sparkSession.createDataFrame([], FOUND).drop("row") if found is None else found.drop("row")


def without_leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "item_id", **changed) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item's passage."""
    row = free_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _leaks(text_rows(numbered, F.col(row).alias("row")), bench, id_col, OPTIONS | changed)
    return numbered.drop(row) if found is None else numbered.join(found.select(F.col("row").alias(row)).distinct(), row, "left_anti").drop(row)


def _held(words: list[str], item: list[str]) -> int:
    """How many of an item's words a stretch holds in any order; no alignment has more."""
    return sum((Counter(item) & Counter(words)).values())
