"""Conversation repair against a plain search over whole conversations, and its grammar against plain symbols."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from sensorlens.llm import common, conversation_repair as repair  # noqa: E402

SPACES = " \t\n\x0b\f\r"


def plain(rows):
    """rows: (turn, role, text) after damage, in order. The best (cost, audit, lines) by a dictionary of all ways kept by state."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(SPACES):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if text.rstrip(SPACES)[-1] not in ".!?" else None)
        seen.add((role, text))
    ways = {"": (0, "", ())}

    def put(to, made, way):
        if to not in made or way[:2] < made[to][:2]:
            made[to] = way

    def fits(last, role):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[last].find(role[:1]) >= 0 and role[:1] != ""

    def grown(ways):
        made = dict(ways)
        for _ in range(3):
            for last, (cost, audit, lines) in list(made.items()):
                for role in ("user", "assistant"):
                    if fits(last, role):
                        put(role[0], made, (cost + 5, audit + "I", (*lines, (role, ""))))
        return made

    for (_, role, text), fault in zip(rows, faults):
        made = {}
        for last, (cost, audit, lines) in grown(ways).items():
            put(last, made, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if fits(last, role):
                put(role[0], made, (cost + more, audit + "K", (*lines, (role, text))))
            for name in ("user", "assistant"):
                if fits(last, name):
                    put(name[0], made, (cost + 1 + more, audit + "R", (*lines, (name, text))))
        ways = made
    cost, audit, lines = min((w for last, w in grown(ways).items() if last in ("", "a")), key=lambda w: w[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    return faults, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def want(rows):
    damaged, out = hurt(rows), []
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, cost, audit, sha = plain(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        firsts = [r[1][:1] for r in mine]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, sha))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(3)
    texts = ["Yes.", "No", "", " \t", "Why?\n", "well", "So!", "ünd. ", "a longer text.", "a longer text", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    rows = [(c, draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts)) for c in [None, *range(60)] for _ in range(draw.randrange(1, 14))]
    return rows + [(900, k // 2, draw.choice(roles[:5]), draw.choice(texts) if k % 3 else f"{k}.") for k in range(700)]


SCHEMA = "conv_id long, turn long, role string, text string, part string, no string, initial string, cost string, kind string, dropped string"


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repair_of_odd_conversations(spark, made, monkeypatch):
    common.ship_package(spark)
    df = spark.createDataFrame([(*r, *"abcdef") for r in made], SCHEMA).repartition(5)
    assert result(repair.repair_report(df)) == want(made)
    cut = repair.segments
    monkeypatch.setattr(repair, "segments", lambda rows: cut(rows, most_rows=7, most_bytes=60))  # a conversation in many segments
    assert result(repair.repair_report(df)) == want(made)
    assert result(repair.repair_report(df.limit(0))) == []
    rows = repair.repaired_rows(repair.repaired(repair.damaged(df.where("conv_id = 900"))))
    lines = "\n".join(f"{r.role}:{r.text}" for r in sorted(rows.collect(), key=lambda r: (r.part, r.no, r.place)))
    assert hashlib.sha256(lines.encode()).hexdigest() == next(r[-1] for r in want(made) if r[0] == 900)


def test_given_conversations(spark, data):
    df = common.table(spark, data, "conversations")
    assert result(repair.repair_report(df)) == want([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_a_conversation_of_which_nothing_is_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hi.")], "conv_id long, turn int, role string, text string")
    assert result(repair.repair_report(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_rules_give_the_matrices_of_plain_symbols():
    draw = random.Random(4)
    rules = [(3, 5), (9, 9), (0, 0), (10, 11), (1, 12)]
    plain_ones, shared = repair.Products([]), repair.Products(rules)
    for _ in range(300):
        symbols = bytes(draw.choice([3, 5, 0, 1, draw.randrange(repair.BASE)]) for _ in range(draw.randrange(40)))
        assert shared.of(symbols) == plain_ones.of(symbols)
    packed = repair.replaced(np.array([3, 5, 3, 5, 3, 5, -1, 0, 0, 0, -1, 3, 5], np.int16), rules)
    assert packed.tolist() == [10, 9, -1, 11, 0, -1, 9]
