"""op6: segments against brute force, and accuracy on labels that the fit didn't see."""

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.queries_toxicity import fitted, held_out
from tidemark.llm.toxicity import fit, score, segments


def brute_segments(x):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""
    spans = [(sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
    best = max(spans, default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return brute_segments(x[:a]) + [(a, b, best[0])] + [(c + b, d + b, s) for c, d, s in brute_segments(x[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 4), max_size=12))
def test_segments(x):
    got = segments(np.array(x, dtype=float))
    want = brute_segments(x)
    assert [s for *_, s in got] == [s for *_, s in want]
    assert all(sum(x[a:b]) == s for a, b, s in got) and all(p[1] <= q[0] for p, q in zip(got, got[1:]))


def test_segments_of_a_million_words_in_seconds():
    falling = np.where(np.arange(1_000_000) % 4 == 0, 2.0, -1.0)
    mixed = np.random.default_rng(1).choice([2.0, -1.0, -2.0, 1.5], 1_000_000)
    began = time.perf_counter()
    assert len(segments(falling)) == 250_000 and len(segments(mixed)) > 0 and len(segments(-falling)) > 0
    assert time.perf_counter() - began < 30


def test_words_of_either_sign(spark):
    docs = spark.createDataFrame([(i, "krelk some words" if i % 4 == 0 else "blessed some words") for i in range(400)], "doc_id long, text string")
    model = fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert model.word("krelk") > 0 > -1 == model.word("other") > model.word("blessed")


def test_held_out_labels_of_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score(docs, fitted(docs, labels)).join(labels, "doc_id").where(held_out()).select("score", "toxic").collect()
    right = np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in rows])
    chance = np.mean([r.toxic == 0 for r in rows])
    assert len(rows) >= 80 and right > max(chance, 0.93)


def corpus(spark, n=600):
    r = random.Random(4)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["zounder", "zoundest", "krelk", "krelk!"])
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    scored = score(docs, fitted(docs, labels)).join(labels, "doc_id").where(held_out())
    rows = scored.collect()
    assert len(rows) > 100
    assert np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in rows]) > 0.97


def test_edges(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 1)], labels.schema)))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "krelk krelk"), (4, "wab " * 40_000 + "krelk zounder"), (5, "krelk"), (5, "krelk")], "doc_id long, text string")
    got = score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score < 0.3
    assert all(r.score > 0.3 for r in got if r.doc_id in (5, None))
    assert score(docs.limit(0), model).count() == 0
    empty = fit(docs, labels.limit(0))
    assert {r.score for r in score(odd, empty).collect()} == {0.0}
    assert {r.score for r in score(odd, fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert {r.score for r in score(odd, fit(docs, labels.where(F.col("toxic") == 0))).collect()} == {0.0}
