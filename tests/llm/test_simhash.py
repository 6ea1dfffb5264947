"""op7: fingerprints and components against plain loops over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests_helpers import brute_groups

from tidemark.llm.components import components
from tidemark.llm.simhash import DEPTH, GrayIndex, _fields, fingerprint, links, near_groups


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ["", " \n", "One", "one TWO", "a b c", "Ärger A a\x0bb\x0cc x x x x x", "w " * 500 + "ÉÀ z"]:
        assert fingerprint(text.encode()) == brute_print(text)


def clustered(n, seed):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 30])):
            out.append(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
    return list(dict.fromkeys(out))


def test_index_finds_every_link():
    values = np.array(clustered(700, 1), dtype=np.uint64)
    index = GrayIndex(values, fan=4)
    q, m = index.neighbours(index.members, 3)
    near = np.bitwise_count(index.members[:, None] ^ index.members) <= 3
    assert sorted(zip(q.tolist(), m.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))
    roots = index.roots(3)
    groups = {}
    for v, r in zip(index.members.tolist(), roots.tolist()):
        groups.setdefault(r, []).append(v)
    assert sorted(map(sorted, groups.values())) == brute_groups(values.tolist())


@pytest.mark.parametrize("hot_bucket", [4096, 3])
def test_links(spark, hot_bucket):
    values = [v - (1 << 64) if v >> 63 else v for v in clustered(600, 2)]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(links(prints, hot_bucket=hot_bucket)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(got.get(v, v), []).append(v & (1 << 64) - 1)
    assert sorted(map(sorted, groups.values())) == brute_groups([v & (1 << 64) - 1 for v in values])


def test_last_buckets_are_bounded():
    masks = [0]
    for _ in range(DEPTH):
        masks = [m for x in masks for m in _fields(x)]
    assert min(m.bit_count() for m in masks) >= 43


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base + " end"), (9, base.upper()), (1, None), (2, ""), (7, "lone text here"), (None, base), (None, "none at all"), (3, base + " end")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = near_groups(docs).collect()
    prints = {v: fingerprint((t or "").encode()) for v, t in rows if v is not None}
    assert len(got) == len(rows)
    groups = brute_groups({fingerprint((t or "").encode()) for _, t in rows})
    for r in got:
        fp = int(r.fingerprint, 16)
        group = next(g for g in groups if fp in g)
        ids = [i for i, p in prints.items() if p in group]
        assert r.component_id == (min(ids) if ids else None)
    assert near_groups(docs.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}
