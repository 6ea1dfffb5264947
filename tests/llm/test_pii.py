"""op9: base spans against Python's re; recall and precision of added spans on planted data, in forms that the examples have and in forms they don't."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.common import text_rows
from tidemark.llm.pii import KINDS, RULED, find, open_candidates, spans, united

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, name in enumerate(RULED) for m in re.finditer(RULES[name], text or "") if passes(name, m.group())]


TEXTS = [
    None, "", "no data", "a@b.c", "a@b.c%d@e.f x@y x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1", "9" * 5000, "4532015112830366 4532-0151-1283-0366", "4532 0151 1283 0367",
    "+1 (319) 555-5132, +12 34 +49.30.1234567-", "é@x.de 😀 a.b@c-d.org\n+1 234 567 8901", "\x01a@b.cc\x01 1 2 3 4", "x" * 4000 + "@", "1 " * 3000, "@@..a@-.-", "a@b.c " * 500,
]


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spans(text_rows(docs, F.col("doc_id").alias("row"))).collect():
        assert [tuple(s) for s in r.base] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_base_spans(spark):
    check(spark, TEXTS)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("0123456789 .-+()@ab%é\n"), max_size=60), min_size=30, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    check(spark, texts)


def planted(n=400, seed=5):
    """(doc_id, text, kind or None, start, end): personal data outside the base rules, and look-alikes, in forms that ``pii_examples`` also writes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = "the river runs past an old house and people walk there when it rains or shines".split()

    def card(good):
        x = "5" + d(14)
        total = sum(int(c) if i % 2 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(x))
        x += str((-total + (0 if good else r.randint(1, 9))) % 10)
        return r.choice(".-").join(x[i : i + 4] + r.choice(["", " "]) * 0 for i in range(0, 16, 4)) if not good else ".".join(x[i : i + 4] for i in range(0, 16, 4))

    made = {
        "email": lambda: f"{r.choice(['tom', 'lisa.m', 'office'])} (at) {r.choice(['north', 'lake9'])} (dot) {r.choice(['com', 'org', 'de'])}",
        "ip": lambda: "[.]".join(str(r.randrange(256)) for _ in range(4)),
        "card": lambda: card(True),
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(7)}"]),
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        "national": lambda: r.choice([f"{r.randint(1, 665):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}", f"JG{d(6)}C"]),
    }
    cue = {"email": "mail ", "ip": "server ", "card": "card ", "phone": "call ", "secret": 'token = "', "national": "ssn "}
    other = [lambda: f"{r.randint(1990, 2030)}-{d(1)}{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"order {r.randint(1, 9)}{d(9)}", lambda: "commit " + "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"ref {card(False)}", lambda: "isbn 978-3-16-" + d(6) + "-0"]
    for i in range(n):
        left, right = (" ".join(r.choice(words) for _ in range(r.randint(2, 20))) for _ in range(2))
        kind = r.choice(KINDS) if i % 2 else None
        value = made[kind]() if kind else r.choice(other)()
        before = f"{left} {cue[kind] if kind else ''}"
        yield i, f"{before}{value} {right}", kind, len(before), len(before) + len(value)


def test_added_spans_are_right(spark):
    rows = list(planted())
    corpus = [(10_000 + i, "plain words in lines of text without any data at all " * 4) for i in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + corpus, "doc_id long, text string")
    got = {r.doc_id: r for r in find(docs).collect()}
    assert len(got) == len(rows) + len(corpus)
    right = wrong = 0
    of_kind = dict.fromkeys(KINDS, 0)
    for i, text, kind, start, end in rows:
        base, spans_ = {tuple(s) for s in got[i].base}, [tuple(s) for s in got[i].spans]
        assert base == set(brute(text)) and base <= set(spans_)
        added = sorted((s for s in spans_ if s not in base), key=lambda s: s[1])
        assert all(a[2] <= b[1] for a, b in zip(added, added[1:]))
        assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in base)
        hit = [s for s in added if kind and KINDS[s[0]] == kind and s[1] < end and start < s[2]]
        right, wrong = right + len(hit), wrong + len(added) - len(hit)
        of_kind[kind] = of_kind.get(kind, 0) + bool(hit or any(s[1] < end and start < s[2] for s in base if kind))
    wanted = {k: sum(x[2] == k for x in rows) for k in KINDS}
    recall = sum(of_kind[k] for k in KINDS) / sum(wanted.values())
    assert recall >= 0.85 and right / (right + wrong) >= 0.9, (of_kind, wanted, right, wrong)
    assert all(not got[i].spans for i, _ in corpus)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "+1 (301) 555-1001", 1), (7, None, 1), (5, None, 1), (5, None, 1), (8, "", 2), (9, "1 " * 30_000 + "a@b.cc", 2)], "doc_id long, text string, spans int")
    got = find(docs, examples=600).collect()
    assert sorted((len(r.base), len(r.spans) >= len(r.base)) for r in got) == [(0, True)] * 4 + [(1, True)] * 2
    assert find(docs.limit(0), examples=600).count() == 0


def test_overlaps(spark):
    found = spark.createDataFrame([(1, [(0, 5, 9), (0, 12, 14)], [(3, 9, 12, 1.0), (3, 8, 10, 1.0), (3, 13, 20, 1.0), (3, 14, 16, 1.0)]), (2, [], [(3, 1, 2, 1.0)])], "row long, base array<struct<kind: int, start: long, end: long>>, candidates array<struct<of: int, start: long, end: long, f: double>>")
    assert sorted((r.row, r.start, r.end) for r in open_candidates(found).collect()) == [(1, 9, 12), (1, 14, 16), (2, 1, 2)]
    chosen = spark.createDataFrame([(1, 0, 1, 5, 0.5), (1, 3, 4, 9, 0.9), (1, 2, 9, 12, 0.9), (2, 1, 1, 3, 0.5)], "row long, of int, start long, end long, p double")
    assert sorted(tuple(r) for r in united(chosen).select("row", "kind", "start", "end").collect()) == [(1, 2, 9, 12), (1, 3, 1, 9), (2, 1, 1, 3)]


def passing(body):
    """Digits and the one that makes them pass the card check."""
    return next(f"{body}{c}" for c in range(10) if passes("card", "0" * (15 - len(body)) + f"{body}{c}"))


def unknown_forms(r):
    """(kind or None, form's name, text before, value): none of these forms is among those of ``pii_examples``."""
    d = lambda k, first="0123456789": r.choice(first) + "".join(r.choice("0123456789") for _ in range(k - 1))
    c = lambda k: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k - 1)) + "7"
    who, host = r.choice(["tom", "lisa.m", "p_weber", "office"]), r.choice(["north", "lake9", "blue-sky"])
    octets, sixteen, resident = [str(r.randrange(1, 256)) for _ in range(4)], passing(d(15, "56")), r.randrange(10**7)
    french = f"{r.choice('12')}{d(2)}{r.randint(1, 12):02}{r.randint(1, 95):02}{d(6)}"
    french += f"{97 - int(french) % 97:02}"
    return [
        ("email", "braces", "reach me: ", f"{who} {{at}} {host} {{dot}} org"),
        ("email", "co.uk", "", f"{who}[at]{host}.co.uk"),
        ("email", "half spelled", "e-mail: ", f"{who} at {host}.com"),
        ("ip", "one point", "from ", f"{octets[0]}.{octets[1]}.{octets[2]}[.]{octets[3]}"),
        ("ip", "last two points", "seen at ", f"{octets[0]}.{octets[1]}(dot){octets[2]}(dot){octets[3]}"),
        ("card", "dot and blank", "paid with ", ". ".join(sixteen[i : i + 4] for i in range(0, 16, 4))[:-1] + sixteen[-1]),
        ("card", "amex in one", "amex ", passing("34" + d(12))),
        ("phone", "one in front", "phone ", f"1-{d(3, '23456789')}-{d(3)}-{d(4)}"),
        ("phone", "ten digits", "ring ", d(10, "23456789")),
        ("phone", "blanks", "mobile: ", f"{d(3, '23456789')} {d(3)} {d(4)}"),
        ("phone", "bracketed zero", "tel ", f"(0{d(2)}) {d(3)} {d(4)}"),
        ("secret", "github", "export GH_TOKEN=", f"ghp_{c(36)}"),
        ("secret", "stripe", 'key: "', f"sk_live_{c(24)}"),
        ("secret", "slack", "bearer ", f"xoxb-{d(12)}-{c(24)}"),
        ("national", "american in one", "ssn ", f"{r.randint(1, 665):03}{r.randint(1, 99):02}{r.randint(1, 9999):04}"),
        ("national", "foreigner", "nie ", f"X{resident:07}{'TRWAGMYFPDXBNJZSQVHLCKE'[resident % 23]}"),
        ("national", "french", "nir ", f"{french[0]} {french[1:3]} {french[3:5]} {french[5:7]} {french[7:10]} {french[10:13]} {french[13:]}"),
        (None, "time", "at ", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}.{r.randint(10, 59)}"),
        (None, "place", "near ", f"{d(2, '1234')}.{d(6)} {d(2, '1234')}.{d(6)}"),
        (None, "article", "article ", f"{d(2, '1234')}-{d(3)}-{d(4)}"),
        (None, "amount", "sum ", f"{d(3, '1234')} {d(3)} {d(3)}.{d(2)}"),
        (None, "account of a firm", "tracking ", d(14, "123456789")),
        (None, "uuid", "run ", "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))),
        (None, "talk", "we met ", f"{r.choice(['look', 'stare'])} at {r.choice(['noon', 'home'])}"),
        (None, "file", "see ", f"results/run-{d(4)}/table_{d(3)}.csv"),
        (None, "wrong letter", "seat ", f"X{resident:07}{'TRWAGMYFPDXBNJZSQVHLCKE'[(resident + 5) % 23]}"),
    ]


@pytest.mark.parametrize("seed", [11, 12])
def test_forms_that_the_examples_lack(spark, seed):
    """Recall of each kind, and how much of what is added is right, over 40 texts of each form.

    Not found, and left in the figures: an address whose only sign is the word "at", cards and American numbers in one
    run of digits.  The least values lie below what single fits gave when this was written (email 0.67, ip 1, card 0.5,
    phone 1, secret 0.68 to 0.96, national 0.62); they guard that state and are no independent aim.  Recall of a form may change
    with the snippets that the examples are written into, so the least values are asked for with two draws.  Numbers inside a secret may give it another kind, so it counts here under which kind it was found.
    """
    r = random.Random(seed)
    words = "the river runs past an old house and people walk there when it rains or shines".split()
    rows = []
    for _ in range(40):
        for kind, form, before, value in unknown_forms(r):
            left, right = (" ".join(r.choice(words) for _ in range(r.randint(3, 20))) for _ in range(2))
            start = len(left) + 1 + len(before)
            rows.append((len(rows), f"{left} {before}{value} {right}", kind, form, start, start + len(value)))
    corpus = [(10_000 + i, "plain words in lines of text without any data at all " * 4) for i in range(50)]
    found = {g.doc_id: [tuple(s) for s in g.spans] for g in find(spark.createDataFrame([x[:2] for x in rows] + corpus, "doc_id long, text string")).collect()}
    hits, of_form, right, wrong = dict.fromkeys(KINDS, 0), {}, 0, 0
    for i, _, kind, form, start, end in rows:
        hit = [s for s in found[i] if s[1] < end and start < s[2]]
        of_form[form] = of_form.get(form, 0) + bool(hit)
        if kind:
            hits[kind] += bool(hit)
        right, wrong = right + len(hit) * bool(kind), wrong + len(found[i]) - len(hit) * bool(kind)
    recall = {k: hits[k] / sum(x[2] == k for x in rows) for k in KINDS}
    least = {"email": 0.6, "ip": 0.9, "card": 0.45, "phone": 0.9, "secret": 0.65, "national": 0.55}
    told = (recall, right, wrong, of_form)
    print(told)
    assert all(recall[k] >= least[k] for k in KINDS) and right / (right + wrong) >= 0.95, told
    assert not any(found[i] for i, _ in corpus)
