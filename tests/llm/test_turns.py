"""Conversation repair against a search through all edits, and windows against one search."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from sieveline.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, n long, code string, place int, d string, digest string"


def slow_repair(rows):
    """The least (cost, audit) of all ways to edit rows (role, text, fault), with what they leave."""
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, _, f) in zip(edits, rows)):
            continue
        for chosen in product(*(("user", "assistant") if e == "R" else (r,) for e, (r, _, _) in zip(edits, rows))):
            # Which inserts make it legal, gap by gap: all of up to two turns in each.
            ways = [("", 0, [])]
            for k in range(len(rows) + 1):
                ways = [(a + "I" * len(g), c + 2 * len(g), out + [(r, "") for r in g]) for a, c, out in ways for g in gaps]
                ways = [w for w in ways if re.fullmatch(r"s?(ua)*u?", "".join(r[:1] for r, _ in w[2]))]
                if k < len(rows):
                    e, f = edits[k], rows[k][2]
                    cost = {"D": 3, "R": 2, "K": 0}[e] + (f == "truncated" and e != "D")
                    ways = [(a + e, c + cost, out + ([] if e == "D" else [(chosen[k], rows[k][1])])) for a, c, out in ways]
            for a, c, out in ways:
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, out)
    return best


def faults_of(rows):
    """(role, text, fault) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def repaired(rows, window):
    """The repair of rows (role, text) by the library: (cost, audit, what is left)."""
    fix, out = turns.Repair(window), []
    for k, (role, text, fault) in enumerate(faults_of(rows)):
        out += fix.give(k, role, text, fault == "blank", fault == "duplicate", fault == "")
    out += fix.end()
    summary = fix.summary()
    left = [(role, text) for place, _, _, role, text in out if place is not None]
    assert summary[-1] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    assert "".join(e for _, e, *_ in out) == summary[-2]
    return summary[-3], summary[-2], left


@pytest.mark.parametrize("seed", range(60))
def test_search_against_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(("user", "assistant", "system", "user", "assistant", "tool", "", "u")), r.choice(("a.", "b!", "c", " ", "d?\n"))) for _ in range(r.randrange(5))]
    assert repaired(rows, 256) == slow_repair(faults_of(rows))


@pytest.mark.parametrize("seed", range(40))
def test_windows_change_nothing(seed):
    r = random.Random(seed)
    rows = [(r.choice(("user", "assistant", "system", "user", "assistant", "x")), r.choice((f"a{i}.", f"b{i}", "")) if r.random() < 0.7 else "same.") for i in range(r.randrange(60))]
    whole = repaired(rows, 1000)
    for window in (1, 2, 7):
        assert repaired(rows, window) == whole


def test_a_very_long_conversation():
    """What is held doesn't grow with the rows."""
    fix, most = turns.Repair(64), 0
    for i in range(20_000):
        fix.give(i, ("user", "assistant", "assistant")[i % 3], f"t{i}.", False, False, True)
        most = max(most, len(fix.held))
    fix.end()
    assert most < 300 and fix.cost == 2 * (20_000 // 3)


def slow_summaries(table):
    """{conv_id: summary} of rows (conv_id, turn, role, text) that are damaged first."""
    out = {}
    for conv in {row[0] for row in table}:
        rows = []
        for _, turn, role, text in (row[:4] for row in table if row[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            role, text = "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        own = [t for t, _, _ in rows if t is not None]
        faults = faults_of([(r, t) for _, r, t in rows])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, left = slow_repair(faults)
        count = lambda f: sum(x == f for _, _, x in faults)  # noqa: E731, B023
        out[conv] = (max(own) - min(own) + 1 - len(set(own)) if own else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def test_summaries_against_brute_force(spark):
    """Nulls in every column, repeated rows, ties, empty and blank texts, extra columns with inner names."""
    r = random.Random(3)
    table = [(conv, r.choice((None, *range(8))), r.choice((None, "user", "assistant", "system", "", "Tool")), r.choice((None, "", "\x0b ", "Yes.", "No", "Ünd so! ", "x?")), 1, "c", 2, "d", "e") for conv in (None, *range(120)) for _ in range(r.randrange(1, 5))]
    table += [(900, 5, "user", "Yes.", 1, "", 2, "", "")] * 3
    table += [(conv, turn, "user", "Only.", 1, "", 2, "", "") for conv in range(1000, 1040) for turn in (0,)]  # some of these lose all rows
    found = turns.summaries(turns.damaged(spark.createDataFrame(table, SCHEMA).repartition(5)))
    slow = slow_summaries(table)
    assert {row[0]: tuple(row)[1:] for row in found.collect()} == slow
    assert any(v[-2] == "" and not any(v[:6]) for v in slow.values())
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
    few = turns.summaries(turns.damaged(spark.createDataFrame(table, SCHEMA)), window=1)
    assert {row[0]: tuple(row)[1:] for row in few.collect()} == slow


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi.", 1), (1, 1, "user", "What", 1), (1, 2, "user", "", 1), (2, 0, "system", "Be.", 1)], "conv_id long, turn long, role string, text string, n long")
    found = [tuple(r) for r in turns.repaired(rows).orderBy("conv_id", "place", "turn").collect()]
    summary = {r["conv_id"]: r["audit"] for r in turns.summaries(rows).collect()}
    for conv in (1, 2):
        own = [f for f in found if f[0] == conv]
        assert sorted(summary[conv]) == sorted(f[2] for f in own)
        kept = [f for f in own if f[1] is not None]
        assert [f[1] for f in kept] == list(range(1, len(kept) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(f[4][:1] for f in kept))


def test_empty_table(spark):
    assert turns.summaries(turns.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    assert turns.repaired(turns.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
