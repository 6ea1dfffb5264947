"""op11: figures by brute force, verdicts that no order changes, and an order that pays."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.quality import BASE_RULES, METRICS, RULES, Rule, Text, cascade, measured, ordered, plan

PROSE = " ".join(f"word{i} and thing{i} more" for i in range(40)) + "."


def brute(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab#é \t\n\x0b\x1c\x85\xa0|"), max_size=60))
def test_figures(text):
    assert tuple(getattr(Text(text), m) for m in METRICS) == brute(text)


@pytest.mark.parametrize(
    ("rejects", "text"),
    [
        ("few_words", "too few"),
        ("repeated_windows", "one two three " * 40),
        ("symbols", PROSE + " #" * 20),
        ("short_words", " ".join(chr(97 + i % 26) + "a" * (i % 5 == 0) for i in range(0, 700, 7)) + " ".join("b c d e f".split())),
        ("long_words", " ".join(f"{i}" + "x" * 30 for i in range(60))),
        ("repeated_lines", "\n".join([f"this is line {i} of {i}" for i in range(12)] + ["again"] * 40)),
        ("capitals", PROSE.upper()),
        ("no_letters", PROSE + " " + " ".join(str(10**6 + i) for i in range(80))),
        ("bullets", "\n".join(f"- item {i} of number {i * i}" for i in range(30))),
        ("broken_off", "\n".join(f"read on about {i} of {i * i}..." for i in range(30))),
        ("placeholder", PROSE + " Lorem IPSUM"),
    ],
)
def test_each_rule_rejects_its_kind(rejects, text):
    rules = {r.name: r for r in (*BASE_RULES, *RULES)}
    assert rules[rejects].rejects(Text(text))
    assert not any(r.rejects(Text(PROSE)) for r in rules.values())


def test_order_by_rejection_per_cost():
    rules = [Rule(n, lambda t: False) for n in ("dear", "cheap", "shadow", "idle")]
    # dear rejects three texts of four, cheap two of them at a hundredth of the cost, shadow only what cheap rejects too.
    sample = [([1000, 10, 12, 5], [True, True, True, False]), ([1000, 10, 12, 5], [True, True, True, False]), ([1000, 10, 12, 5], [True, False, False, False]), ([1000, 10, 12, 5], [False, False, False, False])]
    found = ordered(rules, sample)
    assert [e.rule.name for e in found] == ["cheap", "dear", "idle", "shadow"]
    assert [e.rejected for e in found] == [0.5, 0.5, 0, 0]
    assert [e.rule.name for e in ordered(rules, [])] == ["dear", "cheap", "shadow", "idle"]


def test_whole_tables(spark):
    long = " ".join(f"w{i} v{i}" for i in range(60_000))
    texts = [None, "", " \n", PROSE, PROSE, PROSE.upper(), "the same words " * 60, long, PROSE + " |" * 30]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, PROSE, "x", 1), (None, PROSE, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)
    order = [e.rule for e in plan(docs, sample_rows=5)]
    assert {r.name for r in order} == {r.name for r in RULES}
    for rules in (order, order[::-1]):
        got = cascade(docs, rules).collect()
        figures = lambda t: (120_000, len(long) - 119_999, 0, 0, 0) if t is long else brute(t)
        wanted = sorted(((i, *figures(t), (b := len((t or "").split()) < 50 or t.startswith("the same")), not b and t not in (texts[5], texts[8])) for i, t, *_ in rows), key=str)
        assert sorted(((r.doc_id, *(r[m] for m in METRICS), r.base_failed, r.kept) for r in got), key=str) == wanted
        assert all((r.rejected_by is None) == r.kept for r in got)
    assert cascade(docs.limit(0), order).count() == 0
    assert [e.rule.name for e in plan(docs.limit(0))] == [r.name for r in RULES]


def test_a_rule_behind_a_rejecting_one_is_not_asked(spark):
    def never(text):
        raise AssertionError

    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    assert cascade(docs, [Rule("all", lambda t: True), Rule("never", never)]).first().rejected_by == "all"
    assert len(measured(docs, RULES)) == 1
