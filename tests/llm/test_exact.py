"""op8: the same groups as a plain comparison of whole texts, on blocks of a few bytes."""

import hashlib
import re

from tidemark.llm.exact import Dealt, exact_groups


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, min(groups[bare])[3], len(groups[bare]), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups(spark):
    texts = [None, "", " \n", "abc", "a b c", "ab  c", "abd", "é" * 9, "é" * 8 + "e", "abcdefgh" * 7, "abcdefgh" * 6 + "abcdefgx", "x" + "abcdefgh" * 7, "abcdefgh" * 7 + " ", "ab" * 200, "ab" * 201, " abc"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "abc"), (3, "abc"), (None, "abc"), (None, "lone")] + [(100 + i, "hot copy of a text") for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, name int, row string").repartition(3)
    got = exact_groups(docs, block_bytes=4).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r[3] for r in brute(rows)})
    assert all(r.keep_id == r.doc_id for r in got if r.kept)
    assert exact_groups(docs.limit(0)).count() == 0


def test_hot_blocks_outlive_forgetting():
    """Among thousands of blocks that fill the memory over and over, one met between them is dealt once."""
    dealt, hot, numbers, new = Dealt(7 << 33, 5000), b"h" * 20, set(), 0
    for i in range(4000):
        number, fresh = dealt.number(b"%020d" % i)
        assert fresh and number not in numbers
        numbers.add(number)
        if i % 5 == 0:
            number, fresh = dealt.number(hot)
            new += fresh
            numbers.add(number)
        assert dealt.held == sum(len(c) + 100 for c in dealt.numbers) <= 5000 + 120
    assert new == 1 and len(numbers) == 4001
