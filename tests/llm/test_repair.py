"""Conversation repair against a shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from foresift.llm import block_tables, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, digest long, run long"
TO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Cost and letters of the cheapest way, the least in ASCII, and the repaired lines; rows are (initial, role, text, must go, cut)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, said, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, said, lines
        make = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[make]
        heapq.heappush(heap, (cost + 5, said + "I", at, make, (*lines, name + ":")))
        if at < len(rows):
            initial, role, text, go, cut = rows[at]
            heapq.heappush(heap, (cost + 2, said + "D", at + 1, state, lines))
            if not go:
                heapq.heappush(heap, (cost + 1 + 5 * cut, said + "R", at + 1, make, (*lines, f"{name}:{text}")))
                if (state, initial) in TO:
                    heapq.heappush(heap, (cost + 5 * cut, said + "K", at + 1, initial, (*lines, f"{role}:{text}")))


def expected(table):
    """The audit in plain Python."""
    shown, by = lambda v: " " if v is None else str(v), {}
    for conv, turn, role, text in table:
        found = by.setdefault(conv, [])
        r = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        found += [(turn, "user" if r == 4 else role, text)] * {0: 0, 3: 2}.get(r, 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, plan, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            inked = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            plan.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plan, plan[1:], strict=False))
        cost, said, lines = cheapest(plan)
        out[conv] = {"conv_id": conv, "gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": said, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def frame(spark, table):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in table], SCHEMA)


def same(spark, table):
    found = [r.asDict() for r in repair.audit(frame(spark, table)).collect()]
    wanted = expected(table)
    assert len(found) == len(wanted)
    for r in found:
        assert r == wanted[r["conv_id"]]


@pytest.mark.parametrize(("seed", "run"), [(1, repair.RUN), (2, 3)])
def test_random_conversations(spark, monkeypatch, seed, run):
    monkeypatch.setattr(repair, "RUN", run)  # short runs: conversations of several
    rng = random.Random(seed)
    texts = ["Yes.", "no", " \n", "", "Why?", "so. \t", "é!", "Well", None]
    table = []
    for conv in range(60):
        turns = sorted(rng.choices([*range(12)], k=rng.randint(0, 9)))
        table += [(conv, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 50)}.") for t in turns]
    table += rng.choices(table, k=20)  # repeated rows
    rng.shuffle(table)
    same(spark, table)


def test_edges(spark):
    assert repair.audit(frame(spark, [])).count() == 0
    same(spark, [(None, None, None, None), (None, 0, "user", "Hi."), (1, 0, "system", "Only this."), (2, None, None, "x" * 200_000), (2, 3, "user", "a b " * 50_000 + ".")])


def test_dropped_whole(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair.audit(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark, monkeypatch):
    """A conversation over many runs and tasks, and a message repeated many times."""
    monkeypatch.setattr(repair, "RUN", 64)
    rng = random.Random(5)
    table = [(7, t, rng.choice(["user", "assistant"]), f"Text {t}{rng.choice(['.', '', '?'])}") for t in range(1500)] + [(7, 40, "user", "Again.")] * 500 + [(8, 0, "user", "Hi.")]
    same(spark, table)


def test_block_tables():
    tables, rng = block_tables.Tables(), np.random.default_rng(3)
    assert len(tables.vectors) < 64 and all(min(v) == 0 for v in tables.vectors)
    for _ in range(300):  # a run's table is that of its parts, composed
        symbols = rng.integers(1, 10, rng.integers(2, 15))
        cut = rng.integers(1, len(symbols))
        v, cost, states = tables.summary(symbols)
        (v1, c1, s1), (v2, c2, s2) = tables.summary(symbols[:cut]), tables.summary(symbols[cut:])
        assert (v == v1[v2]).all() and (cost == c2 + c1[v2]).all() and (states == np.take_along_axis(s2, s1[v2], axis=1)).all()
        after = int(rng.integers(len(tables.vectors)))
        for state in range(4):
            assert tables.letters(symbols, after, state) == tables.letters(symbols[:cut], int(v2[after]), state) + tables.letters(symbols[cut:], after, int(s1[v2[after]][state]))
