"""op1: round trips through the store, each chunk stored once, damage found."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm.store import LONGEST, SHORTEST, Merkle, Store, _cut, _fetched, cuts, merkle_root, write
from tidemark.llm.tokens import UnitEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cuts():
    ids = np.random.default_rng(1).integers(0, 49_000, 60_000).astype(np.uint32)
    ends = cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= LONGEST and sizes[:-1].min() >= SHORTEST
    moved = cuts(np.concatenate([ids[:100], [7, 7, 7], ids[100:]]).astype(np.uint32))
    assert len({e + 3 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert cuts(np.zeros(5000, np.uint32))[-1] == 5000 and cuts(np.array([1], np.uint32)) == [1]


def test_merkle():
    leaves = [bytes([i]) for i in range(11)]
    assert len({merkle_root(leaves[:i]) for i in range(12)}) == 12
    assert merkle_root(leaves) != merkle_root(leaves[::-1]) and Merkle().root() == b""


def test_round_trip(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(r.choice(words) for _ in range(20_000))
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 300)))) for i in range(40)]
    rows += [(100, long), (101, long), (102, "start " + long), (103, None), (104, ""), (None, "no id"), (105, "x" * 3000), (101, long), (104, "")] + [(200 + i, long[:4000]) for i in range(20)]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, part int, kind string").repartition(3)
    store = write(docs, PATH, f"file://{tmp_path}/store")
    store.check_manifests()
    tok = UnitEncoder(Path(PATH).read_bytes(), "text")
    want = sorted(((i, tok.whole(t or "") + np.array([1], "<u4").tobytes()) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(store.read().collect(), key=lambda x: (x.part, x.seq))
    assert [(g.doc_id, bytes(g.ids)) for g in got] == want
    for file in Path(tmp_path, "store").glob("*.parquet"):
        seqs = [r["seq"] for r in pq.read_table(file).to_pylist() if r["kind"] == "document"]
        assert seqs == list(range(len(seqs)))
    starts = {s.part: s.part_start for s in store.starts().collect()}
    assert starts[min(starts)] == 0 and max(starts.values()) <= sum(len(x) // 4 for _, x in want)
    contents = store.documents.select(F.explode("shared").alias("s")).groupBy("s.address").count()
    assert contents.where("count > 1").count() == 0
    stored_ids = store.documents.agg(F.sum(F.octet_length("own") + F.aggregate("shared", F.lit(0), lambda a, s: a + F.octet_length(s["content"])))).first()[0] // 2
    distinct = store.documents.select(F.explode(F.arrays_zip("chunks", "lengths")).alias("c")).select("c.*").distinct().agg(F.sum("lengths")).first()[0]
    assert stored_ids == distinct < sum(len(x) // 4 for _, x in want) / 2
    broken = store.table.withColumn("own", F.when(F.col("doc_id") == 5, F.concat(F.lit(b"zz"), F.substring("own", 3, 10**6))).otherwise(F.col("own"))).withColumn("n_tokens", F.when(F.col("doc_id") == 6, 0).otherwise(F.col("n_tokens")))
    broken.write.parquet(f"file://{tmp_path}/broken")
    with pytest.raises(Exception, match="not what its address says"):
        Store(spark, f"file://{tmp_path}/broken").read().count()
    with pytest.raises(ValueError, match="manifest"):
        Store(spark, f"file://{tmp_path}/broken").check_manifests()
    assert write(docs.limit(0), PATH, f"file://{tmp_path}/empty").read().count() == 0


def test_a_hot_chunk_stays_in_place(spark, tmp_path):
    """Half of all documents are empty, so one chunk is named by half of all places; these are split and all come back."""
    rows = [(i, "" if i % 2 else f"word{i} and some of {i * i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = write(docs, PATH, f"file://{tmp_path}/store")
    back = found.read()
    assert {(r.doc_id, r.n_tokens == 1) for r in back.select("doc_id", "n_tokens").collect()} == {(i, bool(i % 2)) for i in range(3000)}
    wanted = spark.createDataFrame([(0, i, b"hot" if i < 900 else bytes([i % 256, i // 256])) for i in range(1000)] * 3, "part int, seq long, address binary")
    shared = wanted.select("address").distinct().withColumn("content", F.col("address"))
    met = _fetched(wanted, shared)
    assert met.count() == 3000 and met.where("address <> content").count() == 0
    assert met.where("address = 'hot'").groupBy(F.spark_partition_id()).count().count() > 1


def test_documents_are_cut_together_as_they_are_alone():
    """Lengths around the shortest chunk and the step that ids are hashed in; hits of the hash near a document's start are no cuts."""
    r = np.random.default_rng(3)
    sizes = [0, 1, 15, 16, 127, 128, 129, 5000, 0, 300_000, 2, *r.integers(0, 900, 400).tolist()]
    docs = [r.integers(0, 49_000, n).astype("<u4") for n in sizes] + [np.zeros(5000, "<u4")]
    alone = [np.concatenate((x, np.array([1], "<u4"))) for x in docs]
    found = list(_cut(docs, 1))
    assert [x.tobytes() for x, _ in found] == [x.tobytes() for x in alone] and [e for _, e in found] == [cuts(x) for x in alone]
    assert list(_cut([], 1)) == []


def test_line_ends_separate_words():
    """Words met at a line end are words of their own, not one for each pair; ids are those of the whole text."""
    encoder = UnitEncoder(Path(PATH).read_bytes(), "word")
    texts = ["One, two.\nThree four\n\nfive", "\n", "", "a\r\nb \n c", "it\n's", "e\ń", "x" * 40 + "\n" + "y" * 40, "ÉT\nÉ isn't\tIT'S"]
    assert [x.tobytes() for x in encoder.encode(pa.array(texts))] == [encoder.whole(t) for t in texts]
    assert not any("\n" in word for word in encoder)
