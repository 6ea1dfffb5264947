"""License scans by patience alignment.

A template's words (letters, digits and inner dots or hyphens; lower-cased; "2.0" and "v2" count as "2") are aligned with
a text's: words that occur once in both are anchors, the longest run of anchors in increasing order in both is kept,
and the stretches between kept anchors are aligned in the same way; where no word is unique, equal words at both ends
of a stretch are taken and what is left between is matched by a longest common subsequence.  Coverage is the share of
the template's words that are aligned.

A window begins with a word of the template and has ``stretch`` times as many words.  It holds a notice if the alignment covers
``min_coverage`` and aligns every *deciding* word: those that tell a license from its relatives (name, version,
variant).  A template is searched from the left.  The first window that holds a notice is compared with those that
begin in the notice, and the one with the longest common subsequence is taken if its notice is larger and overlaps the
first; then the words before and those behind the notice are searched in the same way.  No window that holds a notice is left out: a run of starts is passed over only where the longest
common subsequence of all their words with the template, which no alignment exceeds, is too short; otherwise the run
is halved.

Defined results.  Null and empty texts have no notice.  Of templates that cover overlapping words the one with the
most aligned words stays, then the larger coverage, then the first; but one that reaches over another license's statement gives way
to a shorter one of its own license beside it.  Texts of any length are read whole; time grows with the text, times the templates whose
deciding words it holds, however many notices there are.  Repeated rows come back repeated.  An empty table
gives no row.  Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_rows

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
VERSION = re.compile(r"v?(\d+)(?:\.0)?$")
NOTICE = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("notices", pa.list_(NOTICE))])


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience piles."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, as an increasing run over the matches' places."""
    places = defaultdict(list)
    for j, w in enumerate(b):
        places[w].append(j)
    pairs = [(i, j) for i, w in enumerate(a) for j in reversed(places.get(w, ()))]
    return [pairs[k] for k in longest_increasing([j for _, j in pairs])]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1)}
        anchors = [(i, at[a[i]]) for i in range(a0, a1) if count_a[a[i]] == 1 == count_b.get(a[i], 0)]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not kept:
            out += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:])]
    return sorted(out)


def masks_of(template: list[str]) -> dict[str, int]:
    """Per word, the bits of its places."""
    out: dict[str, int] = defaultdict(int)
    for i, w in enumerate(template):
        out[w] |= 1 << i
    return dict(out)


def common_length(words: list[str], masks: dict[str, int], full: int) -> int:
    """Length of the longest common subsequence with a template, one step of whole-number arithmetic for each word."""
    row = full
    for w in words:
        if hit := masks.get(w):
            matched = row & hit
            row = (row + matched) | (row - matched)
    return (~row & full).bit_count()


def word_of(text: str) -> str:
    number = VERSION.match(text)
    return number[1] if number else text


class Template:
    def __init__(self, name: str, text: str, deciding: str, min_coverage: float, stretch: float):
        self.name, self.words = name, [word_of(w) for w in WORD.findall(text.lower())]
        self.deciding = {word_of(w) for w in deciding.split()}
        if not self.deciding <= set(self.words):
            raise ValueError(f"{name}: {self.deciding - set(self.words)} aren't in the template")
        self.masks, self.full = masks_of(self.words), (1 << len(self.words)) - 1
        self.width, self.least = max(len(self.words), int(stretch * len(self.words))), min_coverage * len(self.words) - 1e-9

    def bound(self, words: list[str], first: int, last: int, stop: int) -> int:
        """No window that begins in [first, last] has more aligned words; windows end at ``stop``."""
        return common_length(words[first : min(last + self.width, stop)], self.masks, self.full)

    def notice(self, words: list[str], start: int, stop: int) -> tuple[int, int, int, frozenset[int]] | None:
        """(aligned words, first, end, places of deciding words) of the window at ``start`` if it holds a notice."""
        pairs = patience(words[start : min(start + self.width, stop)], self.words)
        if len(pairs) < self.least or not self.deciding <= {self.words[j] for _, j in pairs}:
            return None
        return len(pairs), start + pairs[0][0], start + pairs[-1][0] + 1, frozenset(start + i for i, j in pairs if self.words[j] in self.deciding)

    def first_notice(self, words: list[str], places: list[int], lo: int, hi: int) -> tuple[int, tuple] | None:
        """The first window at one of ``places`` in [lo, hi) that holds a notice, with it; windows end at ``hi``.

        Places are gone through in runs, from the left, and no further than the first notice.
        """
        step = max(16, self.width)
        at, end = bisect_left(places, lo), bisect_left(places, hi)
        while at < end:
            work = [(at, min(at + step, end) - 1)]
            at += step
            while work:
                a, b = work.pop()
                if self.bound(words, places[a], places[b], hi) < self.least:
                    continue
                if a < b:
                    half = (a + b) // 2
                    work += [(half + 1, b), (a, half)]
                elif found := self.notice(words, places[a], hi):
                    return places[a], found
        return None

    def notices(self, words: list[str], places: list[int]) -> list[tuple]:
        """All notices of this template; ``places`` are those of its words."""
        out, work = [], [(0, len(words))]
        while work:
            lo, hi = work.pop()
            if got := self.first_notice(words, places, lo, hi):
                start, found = got
                inside = places[bisect_right(places, start) : bisect_left(places, found[2])]
                best = max(inside, key=lambda k: (self.bound(words, k, k, hi), -k), default=start)
                if self.bound(words, best, best, hi) > found[0] and (other := self.notice(words, best, hi)) and other[0] > found[0] and other[1] < found[2]:
                    found = other
                out.append(found)
                work += [(lo, found[1]), (found[2], hi)]
        return out


class Stretches:
    """Disjoint stretches of words, by start."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def put(self, first: int, end: int) -> bool:
        """Takes a stretch if it meets none that is taken."""
        at = bisect_left(self.starts, first)
        if (at and self.ends[at - 1] > first) or (at < len(self.starts) and self.starts[at] < end):
            return False
        self.starts.insert(at, first)
        self.ends.insert(at, end)
        return True


def family(name: str) -> str:
    """A license's name without its version."""
    return name.split("-")[0]


def without_straddling(hits: list[tuple]) -> list[tuple]:
    """Hits but for those that reach over another license's statement to words of their own behind it, where the same license has a
    shorter hit beside that statement: so of "the MIT License or the Apache License, Version 2.0" both stay."""
    hits = sorted(hits, key=lambda h: (h[4], h[5]))
    starts, out = [h[4] for h in hits], []
    for hit in hits:
        name, first, end, decided = hit[3:]
        inside = [h for h in hits[bisect_left(starts, first) : bisect_left(starts, end)] if h[5] <= end and h is not hit]
        other = [h for h in inside if family(h[3]) != family(name) and not h[6] & decided and not any(h[4] <= k < h[5] for k in decided)]
        own = [h for h in inside if h[3] == name and h[6] == decided]
        if not any(a[5] <= b[4] or b[5] <= a[4] for a in other for b in own):
            out.append(hit)
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]], min_coverage: float, stretch: float):
        self.templates = [Template(*t, min_coverage, stretch) for t in templates]
        # A word, not a version, that a template can't do without -> templates.  Few texts hold any.
        self.by_word, self.any = defaultdict(list), []
        for order, t in enumerate(self.templates):
            names = [w for w in t.deciding if not VERSION.match(w)]
            if names:
                self.by_word[min(names, key=lambda w: (sum(w in x.masks for x in self.templates), w))].append(order)
            else:
                self.any.append(order)

    def notices(self, text: str) -> list[dict]:
        low = text.lower()
        # Lower-casing may make a text longer; then words are found first.
        same = len(low) == len(text)
        raw = WORD.findall(low) if same else [w.lower() for w in WORD.findall(text)]
        named = self.by_word.keys() & set(raw)
        if not named and not self.any:
            return []
        words = [word_of(w) if w[0] in "v0123456789" else w for w in raw]
        places: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            places[w].append(i)
        hits = []
        for order in sorted({*self.any, *(o for w in named for o in self.by_word[w])}):
            t = self.templates[order]
            if t.deciding <= places.keys():
                own = sorted(i for w in t.masks for i in places.get(w, ()))
                hits += [(-n, -n / len(t.words), order, t.name, first, end, decided) for n, first, end, decided in t.notices(words, own)]
        kept = []
        taken = Stretches()
        for _, coverage, _, name, first, end, _ in sorted(without_straddling(hits)):
            if taken.put(first, end):
                kept.append((name, -coverage, first, end))
        if not kept:
            return []
        found = [m.span() for m in WORD.finditer(low if same else text)]
        return [{"license": n, "coverage": c, "start": found[a][0], "end": found[b - 1][1]} for n, c, a, b in sorted(kept, key=lambda x: x[2])]


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, *, min_coverage: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, notices): license, coverage, start and end in code points.

    ``templates``: (license, text, deciding words with blanks between); those of :mod:`tidemark.llm.license_texts` by default.
    """
    from tidemark.llm.license_texts import TEMPLATES

    scanner = Scanner(TEMPLATES if templates is None else templates, min_coverage, stretch)

    def run(batches):
        for batch in batches:
            notices = [scanner.notices(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(notices, FOUND.field(1).type)], schema=FOUND)

    return text_rows(docs).mapInArrow(run, "doc_id long, notices array<struct<license: string, coverage: double, start: long, end: long>>")
