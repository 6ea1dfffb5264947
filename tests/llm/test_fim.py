"""op12: the same cuts as a version that keeps all units, and exact texts back."""

import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.fim import count_units, draws, fill_in_middle, restore, transformed, unit_ends

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
TEXT = st.text(alphabet=st.sampled_from("ab<>PSM é\U0001f600\n\t\x0b\x1c\xa0"), max_size=40)


def brute(text, doc_id):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(UNITS, text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=500, deadline=None)
@given(TEXT, st.integers(-5, 10_000))
def test_same_as_with_all_units(text, doc_id):
    assert transformed(text, doc_id, 42, 50, 80) == brute(text, doc_id)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.data())
def test_ranks(text, data):
    ends = [0, *(m.end() for m in re.finditer(UNITS, text))]
    assert count_units(text) == len(ends) - 1
    low = data.draw(st.integers(0, len(ends) - 1))
    high = data.draw(st.integers(low, len(ends) - 1))
    assert unit_ends(text, low, high) == (ends[low], ends[high])


def test_draws_differ_by_seed():
    assert draws(42, 1) != draws(43, 1) and draws(42, None) == draws(42, None)


def test_whole_tables(spark):
    texts = [None, "", " ", "one", "a b  c\n", "has <P> in it", "<", "<S", "x<M", "<P", "é \U0001f600 " * 50, "word " * 100_000]
    rows = [(i * 100 + k, t, "keep", 1) for i, t in enumerate(texts) for k in range(25)] + [(7, "again and again", "k", 1)] * 3 + [(None, "no id here", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = fill_in_middle(docs).withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, *brute(t or "", i)) for i, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
    assert {r.form for r in fill_in_middle(docs.where("doc_id < 900 and doc_id >= 300"), seed=1, fim_percent=100, spm_percent=0).collect()} == {"psm", "plain"}
