"""Quotation linking and language mixtures against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from foresift.llm import language_id, quotes


def plain_links(rows):
    """``{(conv, turn): (own text, number of quotes, reply_to)}`` by comparing every quote with every run of sentences before it."""
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip(" ")
    cut = lambda x: [norm(s) for line in x.split("\n") for s in re.split(r"(?<=[.!?])\s+", line) if norm(s)]
    said = {}
    for conv, turn, text in rows:
        levels = []
        for line in text.split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            levels.append((m.group(1).count(">") if m else 0, line[m.end() :] if m else line))
        groups = [(k, "\n".join(x for _, x in g)) for k, g in itertools.groupby(levels, key=lambda p: p[0])]
        own = [x for k, x in groups if k == 0]
        said[conv, turn] = ("\n".join(own).strip(" "), own, [(k, x) for k, x in groups if k])
    out = {}
    for (conv, turn), (text, _, asked) in said.items():
        links = []
        for level, quote in asked:
            for before in sorted(t for c, t in said if c == conv and t < turn):
                theirs, passages, _ = said[conv, before]
                parts, want = cut(theirs), cut(quote)
                runs = [parts[a : a + len(want)] for a in range(len(parts) - len(want) + 1)]
                if norm(quote) and (norm(quote) in map(norm, [theirs, *passages]) or want in runs):
                    links.append((level, -before))
                    break
        out[conv, turn] = (text, len(asked), -min(links)[1] if links else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_against_a_plain_linker(spark, seed):
    """Threads with nested, trimmed, wrapped and repeated quotes, some changed, some cut within a line or within a sentence."""
    rng, rows = random.Random(seed), []
    sentence = lambda: " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eta"]) for _ in range(rng.randint(1, 5))) + rng.choice([".", "!", "?", ""])
    for conv in range(25):
        texts = []
        for turn in range(8):
            own = "\n".join(" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
            parts = []
            for _ in range(rng.randint(0, 2) if turn else 0):
                lines = rng.choice(texts).split("\n")
                a = rng.randrange(len(lines))
                lines = lines[a : rng.randint(a + 1, len(lines))]
                how = rng.random()
                if how < 0.3:  # some sentences of a line
                    pieces = re.split(r"(?<=[.!?])\s+", lines[0])
                    lines = [" ".join(pieces[rng.randrange(len(pieces)) :])]
                elif how < 0.4:
                    lines = [" ".join(lines)]
                elif how < 0.5:
                    lines[-1] += " changed"
                elif how < 0.6:
                    lines[0] = lines[0].partition(" ")[2]
                parts.append("\n".join("> " + x.replace("a", "A", 1) for x in lines))
                parts.append(sentence())
            texts.append("\n".join([*parts, own]))
            rows.append((conv, turn, texts[-1]))
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {(r["conv"], r["turn"]): (r["text"], r["n_quotes"], r["reply_to"]) for r in quotes.link_quotes(messages).collect()}
    want = plain_links(rows)
    assert found == want and len({r for _, _, r in want.values()}) > 5


def test_a_sentence_of_a_line(spark):
    rows = [(1, 0, "u", "First thing. Second thing! A third\nand more."), (1, 1, "b", "> second thing!\nYes."), (1, 2, "u", "> Second thing! A third\n> and more.\nNo."), (1, 3, "b", "> thing! A third\nWhy?")]
    found = {r["turn"]: r["reply_to"] for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {0: None, 1: 0, 2: 0, 3: None}


def speech(rng, syllables, words):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


def test_languages_against_every_subset(spark):
    """Likelihoods from plain counts, expectation maximisation to its end over each set of languages, the best by penalised likelihood."""
    rng = random.Random(5)
    tongues = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["sch", "er", "ung", "en", "ka"], "cc": ["que", "as", "lo", "cion", "os"]}
    rows = [(k, speech(rng, s, 40), lang) for k, (lang, s) in enumerate(list(tongues.items()) * 12)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    import zlib

    seen = [(lang, text) for k, text, lang in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    counts, contexts = ([Counter() for _ in range(3)] for _ in range(2))
    for lang, text in seen:
        for word in text.split():
            padded = "  " + word + " "
            for j in range(2, len(padded)):
                for k in range(3):
                    counts[k][lang, padded[j - k : j + 1]] += 1
                    contexts[k][lang, padded[j - k : j]] += 1

    def likelihood(word, lang):
        total, padded = 0.0, "  " + word + " "
        for j in range(2, len(padded)):
            p = 1e-6
            for k in range(3):
                p = (counts[k][lang, padded[j - k : j + 1]] + 4.0 * p) / (contexts[k][lang, padded[j - k : j]] + 4.0)
            total += math.log(p)
        return total

    def best(text):
        words = text.split()
        like = np.array([[likelihood(w, lang) for lang in tongues] for w in words])
        like = np.exp(like - like.max(axis=1, keepdims=True))
        found = []
        for size in (1, 2, 3):
            for some in itertools.combinations(range(3), size):
                pi = np.full(size, 1 / size)
                for _ in range(300):
                    joint = like[:, some] * pi
                    pi = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
                found.append((np.log((like[:, some] * pi).sum(axis=1)).sum() - 0.5 * (size - 1) * math.log(len(words)), some, pi))
        _, some, pi = max(found, key=lambda f: f[0])
        return np.array([pi[some.index(k)] if k in some else 0.0 for k in range(3)])

    texts = [speech(rng, tongues[x], 40) for x in tongues for _ in range(4)]
    texts += [speech(rng, tongues[x], a) + " " + speech(rng, tongues[y], b) for x, y in itertools.permutations(tongues, 2) for a, b in ((20, 20), (30, 12))]
    texts += [" ".join(speech(rng, s, 25) for s in tongues.values())]
    assert model.languages == list(tongues)
    for share, text in zip(language_id.proportions(model, texts), texts, strict=True):
        want = best(text)
        assert ((share > 0) == (want > 0)).all() and share == pytest.approx(want, abs=0.05), text


def test_languages_of_equal_share(spark):
    """Two languages learned from the same texts tie: the first by code point is named."""
    rows = [(k, "one and the same text of both", "zz" if k % 2 else "yy") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    same = language_id.Model(model.languages, *[[(k, np.ones_like(v) * v.sum(axis=1, keepdims=True)) for k, v in t] for t in (model.tables, model.contexts)])
    assert {r["lang_pred"] for r in language_id.identify(docs, same, carry=["doc_id"]).collect()} == {"yy"}
