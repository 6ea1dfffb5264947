"""op5: every id in one piece, sequences gapless, choices as close to the capacity as brute force finds."""

from itertools import combinations
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import choose, pack
from tidemark.llm.tokens import UnitEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SPACE, WORDS = UnitEncoder(Path(PATH).read_bytes(), "space"), UnitEncoder(Path(WORD).read_bytes(), "word")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé.,'s\n\t\r\x1c\x85 　́ǅ<|>9_-İΣςक़ﬁẞ中ŉ"), max_size=40))
def test_units_give_the_ids_of_the_whole_text(text):
    texts = pa.array([text, "", f"a {text}", text])
    for encoder in (SPACE, WORDS):
        assert [x.tobytes() for x in encoder.encode(texts)] == [encoder.whole(t) for t in texts.to_pylist()]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("abSTrevmlLd''..,9-_$ÉñİȺŉ\x00\x7f\r\n "), max_size=30))
def test_latin_words_are_cut_as_the_tokenizer_does(text):
    texts = pa.array([text, text.lower()])
    for encoder in (SPACE, WORDS):
        assert [x.tobytes() for x in encoder.encode(texts)] == [encoder.whole(t) for t in texts.to_pylist()]


def test_letters_that_lower_case_to_more_than_one():
    odd = [chr(c) for c in range(0x80, 0x3000) if chr(c).isalpha()] + ["İ", "क़", "\U0001e4d0", "ﬁ"]
    texts = pa.array([f"x{c}{mark} {c}{mark} b{c}" for c in odd for mark in ".,"])
    for encoder in (SPACE, WORDS):
        assert [x.tobytes() for x in encoder.encode(texts)] == [encoder.whole(t) for t in texts.to_pylist()]


def test_other_rules_take_the_whole_text():
    assert UnitEncoder(Path(PATH).read_bytes(), "word").unit == "text" and UnitEncoder(Path(WORD).read_bytes(), "space").unit == "text"
    assert (SPACE.unit, WORDS.unit) == ("space", "word")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 31), min_size=1, max_size=9))
def test_choice_is_the_closest_fill(sizes):
    counts = {k: sizes.count(k) for k in set(sizes)}
    used = choose(counts, sorted(counts), 32)
    assert all(n <= counts[k] for k, n in used.items()) and used[max(sizes)] >= 1
    rest = list(sizes)
    rest.remove(max(sizes))
    best = max(max(sizes) + sum(c) for r in range(len(rest) + 1) for c in combinations(rest, r) if max(sizes) + sum(c) <= 32)
    assert sum(k * n for k, n in used.items()) == best


def test_pieces(spark):
    rows = [(1, "a b c " * 900, 5), (1, "a b c " * 900, 6), (2, None, 1), (3, "", 1), (None, "x y", 1), (4, "word " * 5000, 0)] + [(10 + i, "tie tie", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(2)
    pieces = pack(docs, PATH, window=16).collect()
    fills, ids = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fills.get(p.sequence_id, 0) and p.length * 4 == len(p.ids)
        fills[p.sequence_id] = p.offset + p.length
        ids.setdefault(p.doc_id, []).append((p.start, bytes(p.ids), p.doc_tokens))
    assert max(fills.values()) <= 1024
    for doc_id in (2, 3, None, 4):
        text = next(t for i, t, _ in rows if i == doc_id) or ""
        got = b"".join(x[1] for x in sorted(ids[doc_id]))
        assert got == SPACE.whole(text) + bytes(4) and sorted(ids[doc_id])[0][2] == len(got) // 4
    assert sum(fills.values()) == sum(len(SPACE.whole(t or "")) // 4 + 1 for _, t, _ in rows)
    assert pack(docs.limit(0), PATH).count() == 0
