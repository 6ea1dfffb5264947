"""Toxic passages by maximum-scoring segments of token log-odds.

Fitting.  Labelled rows are sampled to ``sample_rows`` (smallest hash of the id), stored once, which bounds the
vocabulary: words and their first four and five letters that the sample's toxic texts hold more often, or less often, than
chance explains (``min_surprise``, a log-likelihood ratio).  The share of *all* documents that hold a token is its
Dirichlet prior (``prior_weight`` pseudo-texts) in the log-odds between toxic and other texts.  A word scores the
log-odds of its surest token (largest z-score; word or prefix), of either sign, less one; a word without such a token
has log-odds of nought and scores minus one.  That one is the drift which maximum-scoring segments need: without it
a run of words that say nothing would join what stands on both sides.

Scoring.  One pass over a text, linear in its words, finds every maximal segment (Ruzzo and Tompa's rule: disjoint
segments that can't be extended or cut to score more).  With lambda from the score distribution of the words of sampled
texts that aren't toxic, a segment of score S in n words is expected ``n * K * exp(-lambda * S)`` times by chance.  K is
the maximum-likelihood one of the extreme-value distribution of those texts' best segments.  The text's evidence is the
sum of -ln(expectation) over segments expected less than once, plus that of the best one.  A one-variable logistic
fit on the sample turns it into a probability.

Defined results.  Null texts are empty; texts without words get the fitted score of no evidence.  Texts of any length
are read whole.  Without labels of both kinds every score is the share of toxic labels (0 without labels).  Repeated
rows come back repeated; several labels of one id count as toxic if any does; rows with a null label aren't used.
Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_rows, stored, text_rows

WORD = re.compile(r"[^\W\d_]+")
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("segment_score", pa.float64())])))])


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def tokens_of(word: str) -> tuple[str, ...]:
    """The word and its prefixes, which catch inflections; prefixes are marked with a trailing ``*``."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) >= k))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in time linear in the scores.

    A candidate keeps the place of the last one before it whose total on its left is smaller.  A search follows these
    places and so passes over a candidate once at most; if none is smaller, nothing before can change any more, and
    the candidates are final.
    """
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    final: list[tuple[int, int, float]] = []
    start, end, left, through, smaller = [], [], [], [], []
    for a, l, r in zip(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist()):
        b, j = a + 1, len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = smaller[j]
            if j < 0:
                final += zip(start, end, (y - x for x, y in zip(left, through)))
                start, end, left, through, smaller = [], [], [], [], []
            elif through[j] < r:
                # The candidate j and all after it become one with this one.
                keep, a, l, j = j, start[j], left[j], smaller[j]
                del start[keep:], end[keep:], left[keep:], through[keep:], smaller[keep:]
                continue
            start.append(a), end.append(b), left.append(l), through.append(r), smaller.append(j)
            break
    final += zip(start, end, (y - x for x, y in zip(left, through)))
    return final


class Model:
    """Word scores and their calibration; plain data, of a size that ``sample_rows`` bounds."""

    def __init__(self, tokens: dict[str, tuple[float, float]], floor: float, share: float):
        self.tokens, self.floor, self.share = tokens, floor, share
        self.rate, self.k, self.a, self.b, self.flat = 1.0, 1.0, 0.0, 0.0, not tokens
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def word(self, word: str) -> float:
        got = self._words.get(word)
        if got is None:
            best = max((self.tokens[t] for t in tokens_of(word) if t in self.tokens), key=lambda x: abs(x[0]), default=(0.0, 0.0))
            if len(self._words) > 500_000:
                self._words.clear()
            got = self._words[word] = best[1] + self.floor
        return got

    def scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.word, words), dtype=np.float64, count=len(words))

    def evidence(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        scores = self.scores(words)
        kept, total, best = [], 0.0, 0.0
        for a, b, s in segments(scores):
            bits = self.rate * s - math.log(self.k * len(words))
            if bits > 0:
                kept.append((a, b, s))
                total, best = total + bits, max(best, bits)
        return math.log1p(total) + math.log1p(best), kept

    def score(self, words: list[str]) -> tuple[float, list]:
        if self.flat:
            return self.share, []
        x, kept = self.evidence(words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a + self.b * x)))), kept


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, min_docs: int = 3, prior_weight: float = 20.0, min_surprise: float = 24.0, min_odds: float = 2.0) -> Model:
    """documents(doc_id, text), labels(doc_id, toxic) -> model.  At most ``sample_rows`` labelled texts are used."""
    docs = text_rows(docs)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # First about twice the sample by hash, so that what is sorted doesn't grow with the labels.
    share, place = min(1.0, 2 * sample_rows / max(marked.count(), 1)), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = marked.where(place < int(share * (1 << 30))).orderBy(place, "doc_id").limit(sample_rows)
    rows = stored(docs.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity-sample")  # sample_rows ids and labels

    def sampled(batches):
        """Per task: sampled texts of each label with a token; the empty token stands for all of them."""
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[int(toxic > 0)].update({t for w in set(words_of(text)) for t in tokens_of(w)} | {""})
        keys = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names=["token", "d0", "d1"])

    counted = rows.mapInArrow(sampled, "token string, d0 long, d1 long").groupBy("token").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    counted = stored(counted.where(F.col("d0") + F.col("d1") >= min_docs), "toxicity-tokens")
    n0, n1 = next(((r.d0, r.d1) for r in counted.where("token = ''").collect()), (0, 0))
    if not n0 or not n1:
        return Model({}, 0.0, n1 / (n0 + n1) if n0 + n1 else 0.0)
    # Tokens that the labels tell apart: a small part of the sample's vocabulary.
    table = {r.token: (r.d0, r.d1) for r in counted.where(F.col("token") != "").where(surprise(F.col("d0"), F.col("d1"), n0, n1) >= min_surprise).collect()}
    found = docs.select("text").mapInArrow(_background(set(table)), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect() if table else []
    everywhere = {r.token: r.n for r in found}
    texts = everywhere.pop("", 0) or 1
    tokens = {}
    for t, (a, b) in sorted(table.items()):
        prior = max(prior_weight * everywhere.get(t, 0) / texts, 0.01)
        odds1 = math.log((b + prior) / max(n1 + prior_weight - b - prior, 0.5))
        odds0 = math.log((a + prior) / max(n0 + prior_weight - a - prior, 0.5))
        z = (odds1 - odds0) / math.sqrt(1 / (b + prior) + 1 / (a + prior))
        if abs(odds1 - odds0) >= min_odds:
            tokens[t] = (z, odds1 - odds0)
    if not any(odds > 0 for _, odds in tokens.values()):
        return Model({}, 0.0, n1 / (n0 + n1))
    model = Model(tokens, -1.0, n1 / (n0 + n1))
    _calibrate(model, rows)
    return model


def surprise(a: Column, b: Column, n0: int, n1: int) -> Column:
    """Log-likelihood ratio (G2) of b of n1 toxic against a of n0 other texts."""
    both = (a + b) / (n0 + n1)
    terms = [F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) for c, n in ((a, n0), (b, n1)) for k, p in ((c, both), (n - c, 1 - both))]
    return 2 * reduce(Column.__add__, terms)


def _background(wanted: set[str]):
    def run(batches):
        """Per task: texts with each wanted token, and with the empty token all texts."""
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({t for w in set(words_of(text)) for t in tokens_of(w) if t in wanted})
            seen[""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    return run


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Sets lambda and K from the sampled texts that aren't toxic, then the logistic fit; rows are the sample's."""

    def spread(batches):
        for batch in batches:
            hist: Counter = Counter()
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not toxic:
                    hist.update(round(model.word(w), 2) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(hist), pa.float64()), pa.array(list(hist.values()), pa.int64())], names=["value", "n"])

    hist = rows.mapInArrow(spread, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
    s, n = np.array([r.value for r in hist] or [model.floor]), np.array([r.n for r in hist] or [1], dtype=float)
    # One more word of the highest score, so that lambda exists where ordinary texts have no toxic word at all.
    s, n = np.append(s, max(x for _, x in model.tokens.values()) + model.floor), np.append(n, 1.0)
    p = n / n.sum()
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            grows = float((p * np.exp(mid * s)).sum()) > 1
        low, high = (low, mid) if grows else (mid, high)
    model.rate = low

    def best(batches):
        """Per batch: texts that aren't toxic, and the sum of their words' number times exp(-lambda * best segment)."""
        for batch in batches:
            texts, weight = 0, 0.0
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                scores = model.scores(words_of(text))
                if not toxic and len(scores):
                    texts += 1
                    weight += len(scores) * math.exp(-model.rate * max((x for *_, x in segments(scores)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([texts], pa.int64()), pa.array([weight], pa.float64())], names=["texts", "weight"])

    sums = rows.mapInArrow(best, "texts long, weight double").agg(F.sum("texts").alias("texts"), F.sum("weight").alias("weight")).first()
    # P(best <= s) = exp(-K n exp(-lambda s)): its likelihood over the texts is largest at this K.
    model.k = sums.texts / sums.weight if sums.weight else 1.0

    def evidence(batches):
        for batch in batches:
            x = [model.evidence(words_of(t))[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "toxic"])

    points = rows.mapInArrow(evidence, "x double, toxic int").groupBy(F.round("x", 2).alias("x"), "toxic").count().collect()
    x, y, w = (np.array(c, dtype=float) for c in zip(*((r.x, float(r.toxic > 0), r["count"]) for r in points), strict=True))
    a = b = 0.0
    for _ in range(60):  # Newton steps; a weak ridge keeps separable samples finite
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(w * (y - p)).sum() - 1e-3 * a, (w * x * (y - p)).sum() - 1e-3 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    model.a, model.b = a, b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, score, passages); passages are significant segments in words."""

    def run(batches):
        for batch in batches:
            out = [model.score(words_of(t)) for t in batch.column(1).to_pylist()]
            passages = [[{"start": a, "end": b, "segment_score": s} for a, b, s in kept] for _, kept in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.float64()), pa.array(passages, SCORES.field(2).type)], schema=SCORES)

    return text_rows(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<start: long, end: long, segment_score: double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; no row moves."""
    return keep_rows(docs, lambda text: model.score(words_of(text))[0] < threshold)
