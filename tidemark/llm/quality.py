"""Quality rules as a short-circuit cascade.

A rule rejects a text or lets it pass; a text is kept if all rules let it pass.  On a sample every rule is timed and
its verdicts noted; then rules are put in order greedily: next comes the rule that rejects most of the sample's texts that
are still there for the time it takes on these.  A text goes through the rules in that order and leaves at the first one that
rejects it.  Verdicts don't depend on the order, only their cost does, so a sample and a clock may choose it.

What rules share (a text's words, say) is derived once for each text, when a rule first asks for it.  *Metrics* are figures that are wanted
for every text, so they are derived before the cascade and cost a rule nothing; *first* rules come before all others and aren't timed.

The sample has at most ``sample_rows`` texts.  Texts are taken at random from the partitions that Spark reads first, in a larger share until there are enough,
so of a large corpus a few partitions are read, and only times and verdicts come to the driver.

Defined results.  A null text is empty.  Repeated rows come back repeated.  Texts of any length are read whole, one at a time.  An empty
table gives no row and the order in which rules were given, and so does a sample without texts.  Other columns are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS, SMALL = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+")
BULLET, DOTS = re.compile(r"[\x20\x09]*[-*•‣]"), re.compile(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\Z")
NO_LETTER = re.compile(r"[!-@\[-`{-~]+")


class Text:
    """One text and what is derived from it, each thing once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [line for line in self.text.split("\n") if WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def numbers(self) -> np.ndarray:
        """Words as numbers in the order of their first place."""
        known: dict[str, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words that the text has twice or more."""
        if self.n_words < 4:
            return 0
        windows = self.numbers
        for step in (1, 2):  # numbers stay below the count of words, so a pair of them fits
            pairs = windows[:-1] * np.int64(self.n_words) + self.numbers[step:]
            _, windows, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        twice = counts[windows] > 1
        within = np.zeros(self.n_words, bool)
        for i in range(3):
            within[i : i + len(twice)] |= twice
        return int(within.sum())

    @cached_property
    def most_frequent(self) -> int:
        """How often the most frequent word occurs."""
        return int(np.bincount(self.numbers).max()) if self.n_words else 0


def _length(found: list[str]) -> int:
    return sum(map(len, found))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Texts with less than this are no prose, whatever else holds.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: Language-independent rules; each compares whole numbers, so that limits are exact.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 20 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("capitals", lambda t: _length(CAPITALS.findall(t.text)) > _length(SMALL.findall(t.text))),
    Rule("no_letters", lambda t: 10 * sum(1 for w in t.words if NO_LETTER.fullmatch(w)) > 3 * t.n_words),
    Rule("one_word", lambda t: 10 * t.most_frequent > 3 * t.n_words),
    Rule("bullets", lambda t: 10 * sum(1 for line in t.lines if BULLET.match(line)) > 9 * len(t.lines)),
    Rule("broken_off", lambda t: 10 * sum(1 for line in t.lines if DOTS.search(line)) > 3 * len(t.lines)),
    Rule("placeholder", lambda t: "lorem ipsum" in t.text.lower()),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TIMED_ROWS = 64


@dataclass(frozen=True)
class Estimate:
    """A rule's place in the cascade: seconds a text, and the share it rejects of the sample's texts that come so far."""

    rule: Rule
    seconds: float
    rejected: float


def measured(docs: DataFrame, rules: Sequence[Rule], first: Sequence[Rule] = (), metrics: Sequence[str] = (), sample_rows: int = 1000, seed: int = 7) -> list[tuple[list[int], list[bool]]]:
    """For each text of a sample that the first rules let pass: each rule's nanoseconds, and whether it rejects the text."""

    def timed(value: str) -> tuple[list[int], list[bool]]:
        derived, spent, verdicts = Text(value), [], []
        for metric in metrics:
            getattr(derived, metric)
        for rule in () if first_rejecting(first, derived) else rules:
            text = copy(derived)  # what rules share, but for metrics, is paid by each of them
            began = time.perf_counter_ns()
            verdicts.append(bool(rule.rejects(text)))
            spent.append(time.perf_counter_ns() - began)
        return spent, verdicts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TIMED_ROWS):  # few at a time, since Spark stops reading once it has enough
                spent, verdicts = zip(*(timed(v.as_py()) for v in batch.column(1).slice(at, TIMED_ROWS)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(spent, pa.list_(pa.int64())), pa.array(verdicts, pa.list_(pa.bool_()))], names=["spent", "verdicts"])

    share, rows = 0.001, []
    while True:
        sample = text_rows(docs).sample(share, seed) if share < 1 else text_rows(docs)
        rows = sample.mapInArrow(run, "spent array<long>, verdicts array<boolean>").limit(sample_rows).collect()
        if len(rows) == sample_rows or share >= 1:
            break
        share *= max(2, min(50, 1.2 * sample_rows / max(len(rows), 1)))
    return [(r.spent, r.verdicts) for r in rows if len(r.spent) == len(rules)]


def ordered(rules: Sequence[Rule], sample: Sequence[tuple[list[int], list[bool]]]) -> list[Estimate]:
    """Rules by rejection per cost, each estimated on the texts that those before it let pass.

    Once no text is left, or none is rejected, cheaper rules come first.
    """
    spent = np.array([s for s, _ in sample], float).reshape(len(sample), len(rules))
    verdicts = np.array([v for _, v in sample], bool).reshape(len(sample), len(rules))
    left, out, alive = list(range(len(rules))), [], np.ones(len(sample), bool)
    while left:
        seen = alive if alive.any() else np.ones(len(sample), bool)
        cost = {k: float(spent[seen, k].mean()) if len(sample) else 0.0 for k in left}
        share = {k: float(verdicts[alive, k].mean()) if alive.any() else 0.0 for k in left}
        best = max(left, key=lambda k: (share[k] / max(cost[k], 1.0), -cost[k], -k))
        out.append(Estimate(rules[best], cost[best] / 1e9, share[best]))
        alive &= ~verdicts[:, best]
        left.remove(best)
    return out


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, first: Sequence[Rule] = BASE_RULES, metrics: Sequence[str] = METRICS, sample_rows: int = 1000, seed: int = 7) -> list[Estimate]:
    """The cascade's order for a corpus."""
    return ordered(rules, measured(docs, rules, first, metrics, sample_rows, seed))


def first_rejecting(rules: Sequence[Rule], text: Text) -> str | None:
    """The name of the first rule that rejects a text; rules behind it aren't asked."""
    return next((rule.name for rule in rules if rule.rejects(text)), None)


def cascade(docs: DataFrame, order: Sequence[Rule], first: Sequence[Rule] = BASE_RULES, metrics: Sequence[str] = METRICS) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, metrics..., base_failed, kept, rejected_by), one row per document.

    ``rejected_by`` is the first of the first rules and then of ``order`` that rejects the text, null where it is kept.
    """
    fields = [("doc_id", pa.int64()), *((m, pa.int64()) for m in metrics), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())]
    schema = pa.schema(fields)
    ddl = ", ".join(["doc_id long", *(f"{m} long" for m in metrics), "base_failed boolean", "kept boolean", "rejected_by string"])

    def verdict(value: str) -> tuple:
        text = Text(value)
        figures = [getattr(text, m) for m in metrics]
        base = first_rejecting(first, text)
        name = base or first_rejecting(order, text)
        return *figures, base is not None, name is None, name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(verdict(value.as_py()) for value in batch.column(1)), strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return text_rows(docs).mapInArrow(run, ddl)
