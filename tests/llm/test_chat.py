"""op2: every assistant turn an example of its own, masks that hold its text alone, and the way back."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.chat import format_examples, read_back

SCHEMA = "conv_id long, turn long, role string, text string, example_no int, t string"


def wrote(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA).repartition(3)


def ordered(rows, conv):
    own = [(t, r or "", x or "") for c, t, r, x in rows if c == conv]
    return sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def check(spark, rows):
    examples = format_examples(wrote(spark, rows))
    shown = {}
    for e in examples.collect():
        shown.setdefault(e.conv_id, []).append(e)
    back = {r.conv_id: r for r in read_back(examples).collect()}
    assert set(shown) == set(back) == {r[0] for r in rows}
    for conv, found in shown.items():
        turns, found = ordered(rows, conv), sorted(found, key=lambda e: e.example_no)
        said = [x for _, r, x in turns if r == "assistant"]
        tail = turns[-1][1] != "assistant"
        assert len(found) == len(said) + tail and [e.is_last for e in found] == [False] * (len(found) - 1) + [True]
        # A target's example ends with it: what was trained is escaped text, and nothing else is under the mask.
        masked = [e.text[e.loss_start : e.loss_end] for e in found]
        assert [m.replace("\\l", "<").replace("\\b", "\\") for m in masked] == said + [""] * tail
        assert all(a.text == b.text[: len(a.text)] for a, b in zip(found, found[1:]))
        r = back[conv]
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in turns] and r.n_turns == len(turns)
        assert r.loss_text == "".join(said) and r.formatted_chars == sum(len(e.text) for e in found)


def test_defined_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn>user\n\\l \\b"), (1, 2, "user", None), (1, 3, "assistant", "")]
    rows += [(2, 0, "user", "no answer"), (3, None, None, None), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, 1, "assistant", "a"), (None, 0, "assistant", "no id"), (None, None, "us\ner<", "x")]
    rows += [(5, i, ("user", "assistant")[i % 2], "long " * 2000) for i in range(6)] + [(6, 0, "assistant", "é😀" * 100_000)]
    check(spark, rows)
    assert format_examples(wrote(spark, rows).limit(0)).count() == 0
    assert read_back(format_examples(wrote(spark, rows).where(F.col("conv_id") == 99))).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "sys\ntem", ""]), st.text("\\<>/lbn\nturné ", max_size=12)), min_size=1, max_size=25))
def test_any_text(spark, rows):
    check(spark, rows)
