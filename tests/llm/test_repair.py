"""op13: the cheapest edits by enumerating all of them, the same in blocks of any size, and repaired rows that read as they should."""

import hashlib
import re
from collections import defaultdict
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.repair import CODE_OF, CODES, audited, audits, best_edits, damaged, repair

GRAMMAR = re.compile("(s?(ua)+)?")
ROW = st.sampled_from(CODES)


def brute(rows):
    """The least (cost, audit) over all edit sequences up to three inserts at a place, pruned by no cost."""
    best = None
    paths = [(0, "", "")]
    for place in range(len(rows) + 1):
        for _ in range(3):
            paths += [(c + 3, a + "I", r + x) for c, a, r in paths for x in "ua" if not a.endswith("III")]
        paths = list({p for p in paths if re.fullmatch("s?(ua)*u?", p[2])})
        if place == len(rows):
            break
        initial, gone, cut = rows[place]
        after = [(c + 4, a + "D", r) for c, a, r in paths]
        if not gone:
            more = 3 if cut else 0
            after += [(c + more, a + "K", r + (initial or "x")) for c, a, r in paths] + [(c + more + 3, a + "R", r + x) for c, a, r in paths for x in "ua"]
        paths = after
    best = min((c, a) for c, a, r in paths if GRAMMAR.fullmatch(r))
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(ROW, max_size=4))
def test_cheapest_and_least(rows):
    assert best_edits(bytes(CODE_OF[r] for r in rows)) == brute(rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=40), st.integers(1, 7))
def test_blocks_change_nothing(rows, block):
    codes = bytes(CODE_OF[r] for r in rows)
    assert best_edits(codes, block) == best_edits(codes, 1000)


def test_a_very_long_conversation():
    codes = bytes([CODE_OF["u", False, False], CODE_OF["a", False, False], CODE_OF["a", False, True]] * 40_000)
    cost, audit = best_edits(codes)
    assert len(audit.replace("I", "")) == 120_000 and cost == 4 * 40_000 and set(audit) == {"K", "D"}


def by_hand(rows):
    """The contract, conversation by conversation, with the search above."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        after[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = {t for t, *_ in own if t is not None}
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append((role[:1] if role[:1] in "sua" else "", fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = best_edits(bytes(CODE_OF[c] for c in codes))
        lines, i = [], 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else own[i][1:]
            i += letter != "I"
            if letter in "IR":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_whole_tables(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c}.") for c in range(60) for t in range(c % 9)]
    rows += [(100, None, None, None), (100, None, "user", ""), (100, 4, "tool", "no end"), (100, 4, "user", "tie one."), (100, 4, "user", "tie two."), (100, 9, "assistant", "x" * 300_000 + "!")]
    rows += [(None, t, "system" if t == 0 else "user", "same text.") for t in range(5)] + [(101, 1, "user", "copy.")] * 4 + [(102, t, "assistant", "long \u00e9 ?\n\t ") for t in range(1500)]
    rows += [(103, t, "", "empty role.") for t in range(3)]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    got = audited(damaged(turns)).collect()
    wanted = by_hand(rows)
    assert len(got) == len(wanted)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == wanted[r.conv_id], r.conv_id
    empty = audited(damaged(turns.limit(0)))
    assert empty.count() == 0


def test_all_rows_dropped(spark):
    conv = next(c for c in range(200, 400) if crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(conv, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")
    r = audited(damaged(turns)).first()
    assert tuple(r)[:8] == (conv, 0, 0, 0, 0, 0, 0, "") and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "user", ""), (1, 4, "user", "And then"), (2, 0, "user", "Alone.")]
    turns = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, present boolean")
    found = repair(turns).collect()
    for conv in (1, 2):
        kept = sorted((r.position, r.role, r.text) for r in found if r.conv_id == conv and r.position is not None)
        assert [p for p, *_ in kept] == list(range(len(kept))) and GRAMMAR.fullmatch("".join(r[0] for _, r, _ in kept))
    cost = {r.conv_id: r.cost for r in audits(turns).collect()}
    assert cost == {1: 3 + 4 + 6, 2: 3}
    assert sorted(r.edit for r in found if r.conv_id == 2) == ["I", "K"]
