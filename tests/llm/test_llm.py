"""The operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foresift.llm import bpe, exact_dedup, fingerprints, language_id, line_dedup, lm_scoring, mixing, near_dedup, quotes, sharding
from foresift.llm.common import persist
from foresift.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, size long, kept boolean, row string, id string"
BASE = " ".join(f"word{k}" for k in range(60))
EN, DE = "the cat and the dog were in this house. ", "der hund und die katze waren nicht im haus. "
ROWS = [
    (1, BASE, "en", "a"), (2, BASE.upper(), "en", "a"), (3, BASE + " more", "en", None), (3, BASE + " more", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \n ", "de", "b"),
    (7, EN * 9, "en", "c"), (8, DE * 9, "de", "c"), (9, EN * 5 + DE * 5, "en", "c"), (10, "123 !!", "en", "c"), (None, EN * 3, None, "d"), (11, "Éa\nÉA\n" + "x " * 3000, "de", "d"), (12, "too few words", "en", "a"), (13, "TOO few words", "en", "a"),
]
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return persist(spark.createDataFrame([(*r, 0, True, "x", "y") for r in ROWS], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return (text or "").encode().lower().split()


def test_exact_dedup(docs, empty):
    found = exact_dedup.exact_dedup(docs, min_copies=1).collect()
    assert len(found) == len(ROWS) and exact_dedup.exact_dedup(empty).count() == 0
    sizes = Counter(low(r[1]) for r in ROWS)
    assert Counter(r["digest"] for r in found if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in sizes)
    by = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    for r in found:
        assert r["group_size"] == sizes[by[r["digest"]]]
        assert r["keep_id"] == max((x[0] for x in ROWS if low(x[1]) == by[r["digest"]] and x[0] is not None), default=None)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(sizes)


def test_near_dedup(docs, empty):
    found = {(r["id"], r["n_shingles"]): r for r in near_dedup.near_dedup(docs).collect()}
    assert near_dedup.near_dedup(empty).count() == 0
    assert found[1, 56]["component_id"] == found[2, 56]["component_id"] == found[3, 57]["component_id"] == 1
    assert found[13, 1]["component_id"] == 12 and not found[13, 1]["kept"]
    assert all(found[k, 0]["kept"] and found[k, 0]["component_id"] == k for k in (4, 5, 6))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({2, 3, 13})


def test_near_dedup_large_node(spark, monkeypatch):
    """Groups beyond the size that is compared as a whole: branching, parts, and chains of links."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rows = [(k, " ".join(f"w{j}" for j in range(k, k + 40))) for k in range(24)] + [(100 + k, f"other text number {k} of its own kind") for k in range(5)]
    found = {r["id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k] == 0 for k in range(24)) and all(found[100 + k] == 100 + k for k in range(5))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    found = {r["key"]: r["component"] for r in components(edges).collect()}
    assert found == {k: 0 for k in range(21)} | {30: 30, 31: 30}


def trained_on(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


@pytest.mark.parametrize("bucket", [lm_scoring.BUCKET, 40])
def test_lm_score_by_brute_force(docs, empty, spark, monkeypatch, bucket):
    """Every run of words counts, however rare; some are in one partition, some in several; one bucket or thousands."""
    monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
    monkeypatch.setattr(lm_scoring, "SEGMENT", 7)
    more = [(100 + k, f"common words and then rare{k} once more rare{k} once", k % 3) for k in range(12)] + [(200 + k, "the " * 300, 0) for k in range(3)]
    rows = [r[:2] for r in ROWS] + [r[:2] for r in more]
    table = persist(docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string").repartition(3)))
    train = [lm_scoring.tokens(t or "") for i, t in rows if trained_on(i)]
    n = [Counter(tuple(x[k : k + size]) for x in train for k in range(len(x) - size + 1)) for size in (1, 2, 3)]
    total, different = sum(n[0].values()), len(n[0])

    def p(context, w):
        if not context:
            return (n[0][w,] + 0.5) / (total + 0.5 * (different + 1))
        prior = lm_scoring.PRIOR[len(context) - 1]
        return (n[len(context)][*context, w] + prior * p(context[1:], w)) / (n[len(context) - 1][context] + prior)

    want = []
    for i, t in rows:
        x = lm_scoring.tokens(t or "")
        base, score = (sum(math.log10(p(tuple(x[max(0, k - most) : k]), w)) for k, w in enumerate(x)) for most in (0, 2))
        want.append((str(i), not trained_on(i), len(x), sum(n[0][w,] > 0 for w in x), total, base, score))
    got = [(str(r["id"]), *r[1:]) for r in lm_scoring.lm_score(table).collect()]
    want.sort(), got.sort()
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [v for g in got for v in g[5:]] == pytest.approx([v for w in want for v in w[5:]], rel=1e-9)
    for context in ((), (b"rare1",), (b"and", b"then"), (b"not", b"there")):
        assert sum(p(context, w) for w, in n[0]) + p(context, b"unknown") == pytest.approx(1)
    assert lm_scoring.lm_score(empty).count() == 0


def test_lm_packing():
    values = np.array(sorted(random.Random(1).getrandbits(48) for _ in range(1000)), np.uint64)
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(values)) == values).all()
    counts = np.array([0, 1, 254, 255, 256, 2**40])
    assert lm_scoring.unpack_counts(lm_scoring.pack_counts(counts), len(counts)).tolist() == counts.tolist()


def test_language_id(docs, empty):
    model = language_id.train(docs)
    found = {r["row"]["doc_id"]: r for r in language_id.identify(docs, model, carry=["doc_id"]).collect()}
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (4, 5, 6, 10))
    assert set(model.languages) <= {"en", "de"} and all(0 <= r["score"] <= 1 for r in found.values())
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing, carry=["doc_id"]).collect()} == {"und"}


def test_language_mixture(spark):
    rows = [(k, (EN if k % 2 else DE) * 4, "en" if k % 2 else "de") for k in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    share = language_id.proportions(model, [EN * 9, DE * 9, EN * 5 + DE * 5])
    assert share[0].max() == 1 and share[1].max() == 1 and share[0].argmax() != share[1].argmax() and 0.3 < share[2].max() < 0.7


def test_bpe(docs, empty, spark):
    extra = [(50, "x<|endoftext|>y  z \x85　a", None, None), (51, "it's " + "ab" * 2000 + " \n\n q", None, None), (52, "日本語テキスト и ещё 😀", None, None)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    library = Tokenizer.from_file(PATH)
    found = {(r["id"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(more, PATH).collect()}
    want = set()
    for r in ROWS + extra:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.add((r[0], struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert found == want and bpe.encode(empty, PATH).count() == 0


def test_mixing(docs, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS) and mixing.mix(empty).count() == 0
    assert all(r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] + 1e-9 for r in found)
    assert sum({r["source"]: r["target"] for r in found}.values()) == pytest.approx(1.5 * sum(len(words(r[1])) for r in ROWS))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


def test_sharding(docs, empty, spark):
    names, slots = [f"s{k}" for k in range(5)], 101
    table = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names, slots).collect()}
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    owner, tried = {}, dict.fromkeys(names, 0)
    for turn in range(slots):
        n = names[turn % 5]
        while (slot := (number(n + "/offset") % slots + tried[n] * (number(n + "/step") % (slots - 1) + 1)) % slots) in owner:
            tried[n] += 1
        owner[slot], tried[n] = n, tried[n] + 1
    assert table == owner
    assert sharding.assign(docs, names, slots).count() == len(ROWS) and sharding.assign(empty, names, slots).count() == 0


def test_fingerprints(docs, empty):
    found = fingerprints.fingerprints(docs).collect()
    assert len(found) == len(ROWS) and fingerprints.fingerprints(empty).count() == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert len({r["fingerprint"] for r in found if r["id"] == 3}) == 1 and {r["near_next"] for r in found if r["id"] == 5} == {1.0}


def test_line_dedup(docs, empty, spark):
    passage = "\n".join(f"a line of the shared passage, number {k}" for k in range(12))
    rows = [(1, "own start\n" + passage + "\nown end"), (2, passage), (3, "other\n" + passage)]
    found = {r["id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == 0 and found[1]["text"] == rows[0][1] and found[2]["n_removed"] > 0 and found[3]["n_removed"] > 0 and "other" in found[3]["text"]
    assert line_dedup.line_dedup(docs).count() == len(ROWS) and line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_of_short_lines(spark):
    """Passages of 2 to 7 short lines, 51 words or more together, between other lines; one that repeats itself; one of 49 words."""
    split = [(26, 25), (24, 29, 7), (49, 1, 10), (13, 13, 13, 13), (1, 49, 1, 1, 20), (11, 0, 11, 11, 11, 11), (9,) * 6, (3, 48, 3), (17,) * 7]
    passages = ["\n".join(" ".join(f"p{j}l{k}w{w}" for w in range(n)) for k, n in enumerate(sizes)) for j, sizes in enumerate(split)]
    around = lambda i, p: f"start of text {i}\n{p}\nend of text {i}"
    rows = [(i, around(i, passages[i % len(split)])) for i in range(3 * len(split))]
    one = "\n".join(" ".join(f"once{k}w{w}" for w in range(17)) for k in range(4))
    rows += [(100, f"{one}\nbetween\n{one}\nat the end"), (101, around(101, "the same seventeen words of a line again and again in one text without any other thing\n" * 9))]
    few = " ".join(f"few{w}" for w in range(49))
    rows += [(102, f"{few}\nown words"), (103, f"{few}\nothers")]
    found = {r["id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[: 3 * len(split)]:
        want = (text, 0, 0) if i < len(split) else (f"start of text {i}\nend of text {i}", 1, len(passages[i % len(split)]))
        assert (found[i]["text"], found[i]["n_removed"], found[i]["removed_chars"]) == want, i
    assert found[100]["text"] == f"{one}\nbetween\nat the end" and found[101]["text"].count("seventeen") < 9
    assert found[102]["text"] == rows[-2][1] and found[103]["text"] == rows[-1][1]


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "b", "> Hello  there.\n> how are you?\nFine."), (1, 2, "u", ">> Hello there.\n> Fine.\nGood"), (2, 0, "u", None), (2, None, "u", "> hi"), (1, 1, "b", "> Hello  there.\n> how are you?\nFine.")]
    found = [(r["conv"], r["turn"], r["text"], r["reply_to"], r["thread"]) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert (1, 2, "Good", 1, 0) in found and found.count((1, 1, "Fine.", 0, 0)) == 2 and (2, 0, "", None, 0) in found
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_of_some_lines(spark):
    """Two of four lines, with a line of white space between; lines that are no neighbours, or in another order, are no quote."""
    said = "First one.\nSecond  one.\n \nThird one.\nFourth one."
    rows = [(1, 0, "u", said), (1, 1, "b", "> second one.\n>\n> Third one.\nYes."), (1, 2, "u", "> First one.\n> Third one.\nNo."), (1, 3, "u", "> Third one.\n> Second one.\nNo.")]
    rows += [(1, 4, "b", "> Third one.\n> Fourth one.\n>> First one.\n>> Second one.\n>> Third one.\nSo"), (2, 0, "u", "x"), (2, 1, "b", "> second one.\n> Third one.\nYes.")]
    found = {(r["conv"], r["turn"]): (r["text"], r["reply_to"], r["thread"], r["depth"]) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 1] == ("Yes.", 0, 0, 1) and found[1, 4] == ("So", 0, 0, 1)
    assert found[1, 2] == ("No.", None, 2, 0) and found[1, 3] == ("No.", None, 3, 0) and found[2, 1][1] is None
