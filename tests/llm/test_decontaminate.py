"""op10: alignment against a plain matrix, leaks against all pairs."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import align, leaks, seeds_of, without_leaks, words_of


def plain_align(text, item, match=2.0, mismatch=1.0, gap=1.0):
    """Cell by cell: best score, its least start, and of that the least end."""
    row, best = [(0.0, j) for j in range(len(text) + 1)], (0.0, 0, 0)
    for word in item:
        new = [(0.0, 0)]
        for j in range(1, len(text) + 1):
            ways = [(row[j - 1][0] + (match if word == text[j - 1] else -mismatch), row[j - 1][1]), (row[j][0] - gap, row[j][1]), (new[-1][0] - gap, new[-1][1])]
            score, start = min((-s, b) for s, b in ways)
            new.append((-score, start) if score < 0 else (0.0, j))
        best = min([best, *((s, b, j) for j, (s, b) in enumerate(new) if s > 0)], key=lambda x: (-x[0], x[1:]))
        row = new
    return best


def matrix(text, item, match=2.0, mismatch=1.0, gap=1.0):
    h = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if item[i - 1] == text[j - 1] else -mismatch), h[i - 1, j] - gap, h[i, j - 1] - gap)
    return h.max()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=9))
def test_alignment(text, item):
    score, start, end = align(np.array(text, dtype=int), np.array(item), 2.0, 1.0, 1.0)
    assert (score, start, end) == plain_align(text, item)
    assert score == matrix(text, item)
    assert matrix(text[start:end], item) == score


def test_leaks(spark):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    draw = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(draw(r.choice([3, 12, 30])))) for i in range(12)] + [(50, None), (51, "...")]
    rows = []
    for i in range(120):
        words = draw(r.randint(0, 120))
        if i % 3 == 0:
            leak = words_of(items[r.randrange(12)][1])
            for _ in range(r.randint(0, len(leak) // 5)):
                leak[r.randrange(len(leak))] = r.choice(vocabulary)
            if i % 2:
                leak.insert(len(leak) // 2, "added")
            at = r.randint(0, len(words))
            words = words[:at] + leak + words[at:]
        rows.append((i, " ".join(words).title()))
    rows += [(None, items[0][1]), (500, None), (501, ""), (502, " ".join(draw(3000) + words_of(items[1][1]))), (503, items[2][1]), (503, items[2][1])]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in [*items, items[3]]], "item_id long, text string, doc_id int")
    want = []
    for doc_id, text in rows:
        words = words_of(text or "")
        for item_id, item in items:
            item = words_of(item or "")
            n = min(5, len(item))
            if item and set(seeds_of(item, n)) & set(zip(*(words[i:] for i in range(n)))):
                score = matrix(words, item) / (2 * len(item))
                if score >= 0.5:
                    want.append((doc_id, item_id, round(score, 9)))
    # The smallest filter lets every seed through.
    for changed in ({}, {"filter_bits": 19}, {"crowd": 0}):
        got = leaks(docs, bench, rare=1e9, **changed).collect()
        assert sorted(((g.doc_id, g.item_id, round(g.score, 9)) for g in got), key=str) == sorted(want, key=str)
    assert {(g.doc_id, g.item_id) for g in leaks(docs, bench).collect()} <= {w[:2] for w in want}
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_edited_copies_with_default_options(spark):
    """Few of an item's seeds occur anywhere, or a copy's only seeds are the item's most frequent ones."""
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    draw = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [(i, draw(30)) for i in range(8)]

    def edited(words, *places):
        return [f"new{p}" if p in places else w for p, w in enumerate(words)]

    # Item 0 has one copy with 11 of 26 seeds; item 1 an exact copy and six that share the same six seeds.
    rows = [edited(items[0][1], 7, 15, 23), items[1][1], *(edited(items[1][1], 4, 15, 20, 25) for _ in range(6))]
    # The first words of item 2, common and alone, are no leak.
    rows += [items[2][1], *(items[2][1][:8] for _ in range(9)), *(draw(60) for _ in range(10))]
    rows += [edited(items[k][1], *r.sample(range(30), r.randint(0, 6))) for k in range(3, 8) for _ in range(6)]
    rows = [(i, draw(r.randint(0, 40)) + w + draw(r.randint(0, 40))) for i, w in enumerate(rows)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    scores = {(d, i): matrix(words, item) / 60 for d, words in rows for i, item in items if set(seeds_of(words, 5)) & set(seeds_of(item, 5))}
    want = {k: round(v, 9) for k, v in scores.items() if v >= 0.5}
    assert (0, 0) in want and all((d, 1) in want for d in range(1, 8)) and not any((d, 2) in want for d in range(9, 18))
    assert {(g.doc_id, g.item_id): round(g.score, 9) for g in leaks(docs, bench).collect()} == want
    assert {r.doc_id for r in without_leaks(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_items_without_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, two), (3, "x y"), (4, f"{two} {one}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, one), (None, one), (None, two), (7, two), (None, None)], "item_id long, text string")
    got = [(g.doc_id, g.item_id, g.score) for g in leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 1.0), (2, None, 1.0), (2, 7, 1.0), (4, None, 1.0), (4, 7, 1.0)], key=str)
    assert [r.doc_id for r in without_leaks(docs, bench).collect()] == [3]


def test_places_and_ties(spark):
    item = [f"w{i}" for i in range(12)]
    rows = {
        1: ["x"] * 7 + item + ["y"] * 5,
        # Twice in one stretch, twice far apart.
        2: ["x"] * 3 + item + item,
        3: ["x"] * 3 + item + ["y"] * 400 + item,
        # The item's end ahead of its beginning, both as good; near each other and far apart.
        4: ["x"] * 2 + item[5:] + ["y"] * 9 + item[:7],
        5: ["x"] * 2 + item[5:] + ["y"] * 400 + item[:7],
        # A word added, one left out, the better copy second.
        6: ["x"] * 4 + item[:6] + ["new"] + item[6:],
        7: item[:5] + item[6:] + ["y"] * 400 + item,
    }
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    # One id with two texts has the better score; a second item of the same seeds has its own length.
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item[:9] + ["other"] * 9)), (2, " ".join(item * 2))], "item_id long, text string")
    for crowd in (0, 16):
        got = {(g.doc_id, g.item_id): (g.score, g.start_word, g.end_word) for g in leaks(docs, bench, crowd=crowd).collect()}
        one = {d: v for (d, i), v in got.items() if i == 1}
        whole = 7 / 12
        assert one == {1: (1.0, 7, 19), 2: (1.0, 3, 15), 3: (1.0, 3, 15), 4: (whole, 2, 9), 5: (whole, 2, 9), 6: (23 / 24, 4, 17), 7: (1.0, 411, 423)}
        assert got[2, 2] == (1.0, 3, 27) and got[1, 2] == (0.5, 7, 19)


def test_common_phrase(spark):
    """A phrase that begins every item and stands in every document: places meet the items they could reach, not all."""
    r = random.Random(4)
    draw = lambda k: [f"v{r.randrange(4000)}" for _ in range(k)]
    phrase = "choose the best answer to each question from below".split()
    items = [(i, phrase + draw(20)) for i in range(80)]
    rows = [(i, draw(30) + phrase + draw(30)) for i in range(150)]
    # Copies of which every word run but the phrase is broken.
    rows += [(1000 + i, draw(9) + phrase + [w if k % 4 else "new" for k, w in enumerate(items[i][1][9:])] + draw(9)) for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(d, i): round(v, 9) for d, w in rows for i, item in items if (v := align(*numbered(w, item), 2.0, 1.0, 1.0)[0] / (2 * len(item))) >= 0.5}
    assert {(1000 + i, i) for i in range(20)} <= set(want)
    assert {(g.doc_id, g.item_id): round(g.score, 9) for g in leaks(docs, bench).collect()} == want

    made, stretches = [], decontaminate._stretches
    decontaminate._stretches = lambda *given: made.append(stretches(*given)) or made[-1]
    try:
        leaks(docs, bench).collect()
    finally:
        decontaminate._stretches = stretches
    pairs = made[0].select("piece", "item").distinct().count()
    assert len(want) <= pairs < 0.4 * len(rows) * len(items)


def test_recall_against_all_pairs(spark):
    """Of all pairs that align at the least score, whether they share a seed or not, 0.9 are found, at edits of up to a word in six."""
    r = random.Random(11)
    draw = lambda k: [f"v{r.randrange(500)}" for _ in range(k)]
    items = [(i, draw(r.randint(15, 40))) for i in range(30)]
    rows = []
    for i in range(240):
        leak = list(r.choice(items)[1])
        for _ in range(r.randint(0, len(leak) // 6)):
            at = r.randrange(len(leak))
            leak[at : at + 1] = r.choice([["new"], [], [leak[at], "new"]])
        rows.append((i, draw(r.randint(0, 60)) + leak + draw(r.randint(0, 60))))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {(d, i) for d, w in rows for i, item in items if align(*numbered(w, item), 2.0, 1.0, 1.0)[0] >= len(item)}
    got = {(g.doc_id, g.item_id) for g in leaks(docs, bench).collect()}
    print("recall against all pairs", len(got & want), len(want))
    assert got <= want and len(got) >= 0.9 * len(want)


def numbered(text, item):
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return np.array([number.get(w, -1) for w in text]), np.array([number[w] for w in item])
