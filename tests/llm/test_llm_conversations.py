"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quotelens.llm import conversations as C
from quotelens.llm import queries

SF = "/root/testdata/sf0.001"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """(conv, turn, role, text) rows after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def slow_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        shown = VISIBLE.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_audit(initials, faults):
    """(cost, audit) by memoised search; at most two rows are inserted in one place."""
    @functools.cache
    def best(i, state, room):
        found = []
        if i == len(initials):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            go = lambda price, letter, to: found.append((price + (r := best(i + 1, to, 2))[0], letter + r[1]))
            go(3, "D", state)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if initials[i] and state + initials[i] in ("s", "u", "su", "ua", "au"):
                    go(more, "K", initials[i])
                go(2 + more, "R", "a" if state == "u" else "u")
        if room:
            r = best(i, "a" if state == "u" else "u", room - 1)
            found.append((2 + r[0], "I" + r[1]))
        return min(found, default=(10**6, ""))

    return best(0, "", 2)


def slow_report(rows):
    """The contract's columns for one conversation's rows after damage."""
    faults, initials = slow_faults(rows), [r[1][:1] for r in rows]
    cost, audit = slow_audit(tuple(initials), tuple(faults))
    at, state, lines = 0, "", []
    for e in audit:
        if e == "D":
            at += 1
            continue
        other = "assistant" if state == "u" else "user"
        role, text = (rows[at][1], rows[at][2]) if e == "K" else (other, rows[at][2]) if e == "R" else (other, "")
        at += e != "I"
        state = role[:1]
        lines.append((e, role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in lines))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, cost, audit, sha), lines


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def as_tuple(r):
    return tuple(r[n] for n in C.REPORT.names)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, SF).collect()
    want = {k: slow_report(damage(v))[0] for k, v in by_conversation(rows).items()}
    assert len(got) == len(want) and {r.conv_id: as_tuple(r) for r in got} == want


@pytest.fixture(scope="module")
def odd_rows():
    draw = random.Random(8)
    texts = ["Yes.", "No", "What?", "", " \t", None, "same!", "x" * 9000, "é", "a:b\nuser:c.", "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ape", "USER"]
    rows = [(c, t, draw.choice(roles), draw.choice(texts)) for c in range(120) for t in draw.sample(range(30), draw.randrange(1, 12))]
    rows += [(None, t, draw.choice(roles), draw.choice(texts)) for t in range(9)] + [(7, None, "user", "null turn."), (7, None, "user", "null turn."), (8, 3, "user", "No")]
    rows += [(500, t, draw.choice(roles[:3]), f"turn {t % 90}{draw.choice(['.', '', '!'])}") for t in range(400)]  # one large conversation
    rows += [(c, 1, "user", "x.") for c in range(600, 700) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]  # nothing is left of these
    return rows


@pytest.mark.parametrize("bits", [3, 16])
def test_odd_conversations_in_one_task_and_in_pieces(spark, odd_rows, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    df = spark.createDataFrame([(*r, "clash", 1) for r in odd_rows], "conv_id long, turn long, role string, text string, audit string, __at long")
    want = {k: slow_report(damage(v)) for k, v in by_conversation(odd_rows).items()}
    broken = C.damaged(df)
    got = C.repair(broken, gone="gone").collect()
    assert len(got) == len(want)
    for r in got:
        assert as_tuple(r) == want[r.conv_id][0], r.conv_id
    turns = C.repaired_turns(broken, gone="gone").collect()
    lines = by_conversation([(r.conv_id, r.place, r.edit, r.role, r.text) for r in turns])
    assert {k: [x[2:] for x in sorted(v, key=lambda x: x[1])] for k, v in lines.items()} == {k: v[1] for k, v in want.items() if v[1]}


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(df).count() == 0 and C.repaired_turns(df).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", True), (2, 4, "assistant", "b.", True), (3, 5, "user", "c.", False)],
                                 "conv_id long, turn long, role string, text string, gone boolean")
    got = {r.conv_id: as_tuple(r) for r in C.repair(gone, gone="gone").collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", C.EMPTY)
    assert got[1] == nothing and got[2] == nothing and got[3][5:7] == (2, "KI")


def test_ranks_follow_the_audits():
    draw = random.Random(2)
    for _ in range(200):
        sizes = [draw.randrange(0, 9) for _ in range(5)]
        n = sum(sizes)
        initial, fault = np.array([draw.randrange(4) for _ in range(n)], np.int64), np.array([draw.randrange(4) for _ in range(n)], np.int64)
        lattice = C.Lattice(initial, fault, np.cumsum([0, *sizes]), np.tile(C.AT_END, (5, 1)), np.ones(5, bool))
        audits, ends = lattice.audits(4 * lattice.first)
        assert set(ends.tolist()) <= {0, 3}
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        for p, at in enumerate(np.cumsum([0, *sizes]).tolist()[:-1]):
            rows = slice(at, at + sizes[p])
            want = slow_audit(tuple("xsua"[i] for i in initial[rows]), tuple(names[f] for f in fault[rows].tolist()))
            assert (int(lattice.cost[lattice.first[p], 0]), audits[p]) == want
