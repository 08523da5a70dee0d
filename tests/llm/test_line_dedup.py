"""Line dedup against a matcher that compares every window's text with those of all others."""

import random

import pytest

from foresift.llm import line_dedup


def windows(text):
    """All windows of lines subject to removal, by their definition: (first line, line after the last)."""
    lines = text.split("\n")
    words = [len(x.split()) for x in lines]
    ends = [k for k, n in enumerate(words) if n]
    found = set()
    for a in ends:
        for b in ends:
            n = sum(words[a : b + 1])
            if a <= b and n >= 50 and (n - words[b] < 50 or n - words[a] < 50):
                found.add((a, b + 1))
    at = 0
    for chunk, can_go in line_dedup.chunks(text):
        n = chunk.count("\n") + 1
        if can_go:
            found.add((at, at + n))
        at += n
    return found


def plain(rows):
    """What stays of every text, comparing texts of windows pairwise, first occurrences by id and line."""
    spots = [(i, a, b, "\n".join(text.split("\n")[a:b])) for i, text in sorted(set(rows)) for a, b in windows(text)]
    out = {}
    for i, text in rows:
        gone = set()
        for j, a, b, x in spots:
            if j != i:
                continue
            f, c = min((g, d) for g, d, _, y in spots if x == y)
            if (f, c) != (i, a):
                gone |= set(range(max(a, c + b - a) if f == i else a, b))
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def texts(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.choice((0, 3, 8, 20, 30, 55))))
    pool = [line() for _ in range(25)]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(6)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(blocks) if rng.random() < 0.5 else [rng.choice([line(), "", " \t", f"own line {i}"])]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("seed", "digest"), [(1, line_dedup.DIGEST), (2, line_dedup.DIGEST), (3, 1)])
def test_against_a_plain_matcher(spark, seed, digest):
    """A digest of one byte calls many different windows the same, and the comparison of bytes has to find that out."""
    rows = texts(seed)
    found = {r["id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=digest).collect()}
    assert found == plain(rows) and any(found[i] != text for i, text in rows)


def test_edge_rows(spark):
    """Null ids and texts, repeated rows, and columns named as those of the result."""
    p = "\n".join(" ".join(f"w{k}{j}" for j in range(9)) for k in range(7))
    rows = [(None, p, "x", 1), (3, p, None, 2), (3, p, "y", 2), (4, None, None, None), (5, "", "z", 0)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, id string, k int")).collect()
    assert sorted((r["id"] or 0, r["text"], r["n_removed"]) for r in found) == [(0, p, 0), (3, "", 1), (3, "", 1), (4, "", 0), (5, "", 0)]
