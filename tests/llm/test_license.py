"""op3: alignments against plain searches, notices in texts."""

import random
import time
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.license import Scanner, Template, common_length, common_subsequence, longest_increasing, masks_of, patience, scan
from tidemark.llm.license_texts import TEMPLATES


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_increasing(values):
    got = [values[i] for i in longest_increasing(values)]
    best = max((k for k in range(len(values) + 1) for c in combinations(values, k) if all(x < y for x, y in zip(c, c[1:]))), default=0)
    assert len(got) == best and all(x < y for x, y in zip(got, got[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef", max_size=12), st.text("abcdef", max_size=12))
def test_alignment_is_common_and_increasing(a, b):
    assert len(common_subsequence(list(a), list(b))) == lcs(a, b)
    pairs = patience(list(a), list(b))
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        inner = [(i, b.index(x)) for i, x in enumerate(a) if x in b]
        assert len(pairs) == len(longest_increasing([j for _, j in inner]))


def brute(words, template):
    """Whether any window holds a notice: every window is aligned, none is passed over."""
    own = set(template.words)
    return any(template.notice(words, i, len(words)) for i, w in enumerate(words) if w in own)


@pytest.mark.parametrize("deciding", ["", "copied notice"])
def test_finds_what_brute_force_finds(deciding):
    r = random.Random(6)
    text = "this work may be copied and changed by all who keep this notice"
    template, scanner = Template("X", text, deciding, 0.8, 1.5), Scanner([("X", text, deciding)], 0.8, 1.5)
    found = 0
    for _ in range(400):
        filler = [r.choice(["this", "by", "and", "zzz", "lorem", "be", "notice"]) for _ in range(r.randint(0, 40))]
        copy = text.split()
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = r.choice(["zzz", "this"])
        if r.random() < 0.3:
            copy.insert(r.randrange(len(copy)), "added")
        at = r.randint(0, len(filler))
        words = filler[:at] + copy + filler[at:]
        if r.random() < 0.3:
            words += text.split()
        got = scanner.notices(" ".join(words))
        assert bool(got) == brute(words, template)
        # Nothing is left between and beside the notices.
        edges = [0, *(len(" ".join(words)[: n[k]].split()) for n in got for k in ("start", "end")), len(words)]
        assert not any(brute(words[a:b], template) for a, b in zip(edges[0::2], edges[1::2]))
        found += bool(got)
    assert 100 < found < 400


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef", max_size=30), st.text("abcdef", min_size=1, max_size=12))
def test_bound_is_the_common_subsequence(a, b):
    assert common_length(list(a), masks_of(list(b)), (1 << len(b)) - 1) == lcs(a, b)


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", "CC-BY-3.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
        ("Released under the BSD License.", "BSD"),
        ("Released under the Apache License.", "Apache"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("GNU Affero General Public License v3", "AGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License version 3.", "AGPL-3.0"),
        ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
        ("Released under the XYZ License.", None),
        (" ".join(t for n, t, _ in TEMPLATES if n == "BSD-3-Clause" and len(t) > 1300), "BSD-3-Clause"),
        (" ".join(t for n, t, _ in TEMPLATES if n == "BSD-2-Clause" and len(t) > 1000), "BSD-2-Clause"),
        (" ".join(t for n, t, _ in TEMPLATES if n == "MIT" and len(t) > 900), "MIT"),
    ],
)
def test_names(text, want):
    assert [n["license"] for n in Scanner(TEMPLATES, 0.8, 1.5).notices(text)] == [want] * (want is not None)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under Apache-2.0", ["Apache-2.0"]),
        ("Licensed under GPLv2", ["GPL-2.0"]),
        ("GNU GPL version 2", ["GPL-2.0"]),
        ("GPL v3", ["GPL-3.0"]),
        ("LGPLv2.1 or later", ["LGPL-2.1"]),
        ("Apache 2.0 license", ["Apache-2.0"]),
        ("MIT licensed", ["MIT"]),
        ("the MIT License (MIT)", ["MIT"]),
        ("EUPL-1.2", ["EUPL-1.2"]),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation", ["GPL-3.0"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", ["Apache-2.0"]),
        ("Dual licensed under the MIT License or the Apache License, Version 2.0", ["MIT", "Apache-2.0"]),
        ("Dual licensed under the Apache License, Version 2.0 or the MIT License.", ["Apache-2.0", "MIT"]),
        ("Licensed under the GNU General Public License, version 2 or the MIT License", ["GPL-2.0", "MIT"]),
        ("Licensed under either of Apache-2.0 or MIT licensed", ["Apache-2.0", "MIT"]),
        ("the general public has a license to use version 2 of the mit of apache", []),
    ],
)
def test_short_and_dual_statements(text, want):
    assert [n["license"] for n in Scanner(TEMPLATES, 0.8, 1.5).notices(text)] == want


def test_many_statements_take_time_in_proportion():
    scanner, took = Scanner(TEMPLATES, 0.8, 1.5), []
    for n in (5_000, 50_000):
        text = "Licensed under the Apache License, Version 2.0. Some more words here. " * n
        began = time.process_time()
        assert [x["license"] for x in scanner.notices(text)] == ["Apache-2.0"] * n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]


def test_shuffled_notice_words_take_time_in_proportion():
    r = random.Random(3)
    scanner, pool = Scanner(TEMPLATES, 0.8, 1.5), [w for _, t, _ in TEMPLATES for w in t.split()]
    long = max((t for _, t, _ in TEMPLATES), key=len).split()
    texts = [" ".join(r.choice(pool) for _ in range(60_000)), " ".join(w for _ in range(200) for w in r.sample(long, len(long))), "license " * 60_000]
    began = time.perf_counter()
    for text in texts:
        scanner.notices(text)
    assert time.perf_counter() - began < 60


def test_documents(spark):
    texts = {n: t for n, t, _ in reversed(TEMPLATES)}
    mit, gpl, notice = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", texts["Apache-2.0"]
    rows = [(1, f"some text. {mit} more text"), (2, f"{gpl}\n{gpl}\n{mit.upper()}"), (3, None), (4, ""), (5, "the a of license under"), (6, ("w " * 30_000) + notice.replace('"AS IS"', "as-is") + " w" * 10), (None, mit), (7, mit), (7, mit), (8, "İ " + mit)]
    docs = spark.createDataFrame([(*x, "n", 0.1) for x in rows], "doc_id long, text string, notices string, coverage double")
    got = scan(docs).collect()
    assert len(got) == len(rows)
    names = {(r.doc_id, *(n.license for n in r.notices)) for r in got}
    assert names == {(1, "MIT"), (2, "GPL-3.0", "GPL-3.0", "MIT"), (3,), (4,), (5,), (6, "Apache-2.0"), (None, "MIT"), (7, "MIT"), (8, "MIT")}
    one = next(r for r in got if r.doc_id == 1).notices[0]
    assert one.coverage == 1.0 and rows[0][1][one.start : one.end] + "." == mit
    assert scan(docs.limit(0)).count() == 0
