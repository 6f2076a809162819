import functools
import itertools
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from quotemill.llm import repair
from quotemill.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if lot:
            role = "user" if lot == 4 else role
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            out += [(conv, turn, role, text)] * (2 if lot == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        trimmed = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not trimmed else 2 if (role, text) in seen else 3 if trimmed[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by trying all edits; the pattern is checked by its meaning."""

    @functools.cache
    def best(i, last, inserted):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}
        into = fits[-1]
        if inserted < 3:
            c, a, t = best(i, into, inserted + 1)
            options.append((c + 3, "I" + a, (f"{name[into]}:", *t)))
        if i < len(rows):
            role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, t))
            if faults[i] not in (1, 2):
                extra = 3 * (faults[i] == 3)
                if role[:1] and role[0] in fits:
                    c, a, t = best(i + 1, role[0], 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, into, 0)
                options.append((c + 3 + extra, "R" + a, (f"{name[into]}:{text}", *t)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        said = [(r[2], r[3]) for r in mine]
        faults = faults_of(said)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:]))
        cost, audit, repaired = cheapest(tuple(said), tuple(faults))
        digest = sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def got_from(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_query_equals_brute_force(spark, small):
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_from(QUERIES["op12_conversation_repair"](spark, small)) == brute(rows)


def odd_rows():
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "assistant", "user"]
    texts = ["Hi.", "Yes!", "cut", "", " \n", None, "A.", "B. ", "C?\n", "a:\nb."]
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(0, 12))):
            rows.append((conv, int(turn) if rng.random() > 0.1 else None, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (99, 5, "system", "w " * 200_000), (98, 7, "user", "x")]
    return rows + rows[:20]


@pytest.mark.parametrize("segment", [512, 3])
def test_odd_rows(make, spark, monkeypatch, segment):
    """Null ids, turns, roles and texts, other roles, repeated rows, empty and long texts, several segments."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "FAN", 2)
    monkeypatch.setattr(repair, "BLOB", 5)
    rows = odd_rows()
    assert got_from(repair.audits(make([(*r, "x") for r in rows], SCHEMA))) == brute(rows)
    assert got_from(repair.audits(spark.createDataFrame([], SCHEMA))) == []


def test_repaired_turns_fit_the_pattern(make):
    rows = [r for r in damage(odd_rows())]
    fixed = repair.repair(make(rows, "conv_id long, turn long, role string, text string"))
    by = {}
    for r in sorted(fixed.turns.collect(), key=lambda r: (r.seg, r.place)):
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert by and all(re.fullmatch("s?(ua)+", "".join(found)) for found in by.values())
    empty = {r.conv_id for r in fixed.reports.where("audit NOT RLIKE '[IKR]'").collect()}
    assert {r.conv_id for r in fixed.reports.collect()} == set(by) | empty


def test_every_short_conversation():
    """All rows of three roles with all faults, up to four rows, in one segment and in several."""
    codes = [role + 4 * fault for role in range(4) for fault in (0, 1, 3)]
    end = repair.with_inserts(repair.ACCEPTED[None])
    names = ["system", "user", "assistant", "tool"]
    for n in range(1, 4):
        cases = list(itertools.product(codes, repeat=n))
        after = np.repeat(end, len(cases), 0)
        found = repair.Ranking([np.array(c) for c in cases], after, np.ones(len(cases), bool))
        audits = found.audits(np.zeros(len(cases), np.int64))
        cut = repair.matrices([np.array(c[:1]) for c in cases])
        for case, audit, cost, first in zip(cases, audits, found.start_costs[:, 0], cut):
            want = cheapest(tuple((names[c % 4], "t") for c in case), tuple(c // 4 for c in case))
            assert (cost, audit) == want[:2]
            rest = repair.costs_of(*repair.padded([np.array(case[1:])]), end)[0][0]
            assert (first + rest[None]).min(axis=1)[0] == cost


def test_ranks_order_audits():
    """Pointers of all lengths and the letters along them."""
    arcs = np.full((5, 5), -1)
    arcs[1, 0], arcs[3, 0], arcs[2, 1], arcs[4, 2], arcs[3, 3] = 1, 2, 3, 3, 4
    label, jumps = repair.ranked_paths(arcs)
    assert label.tolist() == [1, 2, 4, 3, 0]
    assert jumps[0].tolist() == [1, 3, 3, 4, 4] and jumps[-1].tolist() == [4] * 5
