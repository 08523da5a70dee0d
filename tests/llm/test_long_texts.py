"""Fingerprints against brute force, and texts of very many lines in the operators that work with array functions."""

import random
import re

import pytest

from foresift.llm import fingerprints, quotes

def pieces(text):
    low, high = fingerprints.PIECE
    return set(re.findall(rf"[^\n]{{{low},{high - 1}}}?[.,;:!?](?=\s|$)|[^\n]{{1,{high}}}", text))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return "".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(500)) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(n))


def test_fingerprints_by_brute_force(spark):
    """The edited text, the order of the next one, and the sets' likeness; with null and empty texts, a null id, one line, and many differences."""
    rng = random.Random(5)
    rows = [(k * 3, prose(rng, rng.choice([0, 3, 30, 200, 900]))) for k in range(40)] + [(500, None), (501, "same"), (502, "same"), (503, "é" * 7), (None, "last of all"), (504, prose(rng, 30).replace("\n", " "))]
    found = {r["id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (found[i]["n_chars"], found[i]["edited"]) == (len(text), edited)
        assert found[i]["near_edited"] == pytest.approx(likeness(text, edited)) and found[i]["near_next"] == pytest.approx(likeness(text, after))
    assert found[501]["fingerprint"] == found[502]["fingerprint"] and found[504]["near_edited"] > 0


def test_fingerprints_of_a_long_text(spark):
    rows = [(1, "\n".join(f"line {k} of a long text" for k in range(50_000))), (2, "\n".join(f"line {k} of a long text" for k in range(25_000, 60_000)))]
    found = {r["id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2]["near_next"] == pytest.approx(25_000 / 60_000) == pytest.approx(found[1]["near_next"])


def test_quotes_of_long_messages(spark):
    lines = [f"line {k} of a long message" for k in range(50_000)]
    quoted = "\n".join(("> " if k % 2 else ">> ") + x for k, x in enumerate(lines))  # a passage a line
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "b", "\n".join("> " + x for x in lines[20_000:45_000]) + "\nYes."), (1, 2, "u", quoted + "\nNo."), (1, 3, "u", "> " + lines[7] + "\n> " + lines[9] + "\nWhy?")]
    found = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(found[k]["text"], found[k]["reply_to"], found[k]["n_quotes"]) for k in (1, 2, 3)] == [("Yes.", 0, 1), ("No.", 0, 50_000), ("Why?", None, 1)]


def test_long_reply_chain(spark):
    """Every message quotes the one before: each is a row of fixed size, in reply order."""
    rows = [(1, k, "u", (f"> message number {k - 1}\n" if k else "") + f"message number {k}") for k in range(200)]
    found = {r["turn"]: (r["reply_to"], r["thread"], r["depth"]) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {k: (k - 1 if k else None, 0, k) for k in range(200)}


def test_shared_pieces_count_in_texts_of_any_length(spark):
    """Half of every text stays in its edited version: the likeness is above 0 on both sides of 600 characters, and beyond."""
    rng, rows = random.Random(9), []
    for k in range(60):
        text = ""
        while len(text) < 300 + 25 * k:
            text += " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(4, 9))) + rng.choice([". ", "! ", ".\n"])
        rows.append((k, text))
    for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0 < r["near_edited"] < 1


def test_many_line_feeds():
    """A passage before a million line feeds: as many windows as lines with words, not as lines."""
    import time

    from foresift.llm import line_dedup

    text = "\n".join(" ".join(f"w{k}{j}" for j in range(20)) for k in range(6)) + "\n" * 1_000_000 + "the end"
    began = time.process_time()
    found = line_dedup.spans(text)
    assert time.process_time() - began < 20 and len(found) < 30 and sum(n for _, n in found) < 3_000_000
