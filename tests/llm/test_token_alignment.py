"""Token alignment against the two libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foresift.llm import queries, runs, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, runs long, groups string"


def plain(texts):
    """The contract's columns of every text, by loops."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters, k = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + k)], k = byte, k + 1
    raw_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(raw_a, x)) != whole or b"".join(map(raw_b, y)) != whole:
            x, y = [], []
        groups, links, p, q, i, j = [], [], 0, 0, 0, 0
        while i < len(x):
            own_a, own_b = [x[i]], [y[j]]
            p, q, i, j = p + len(raw_a(x[i])), q + len(raw_b(y[j])), i + 1, j + 1
            while p != q:
                if p < q:
                    own_a.append(x[i])
                    p, i = p + len(raw_a(x[i])), i + 1
                else:
                    own_b.append(y[j])
                    q, j = q + len(raw_b(y[j])), j + 1
            groups.append((own_a, own_b))
            links.append((own_b[-1], own_a[-1]))
        found.append((len(x), len(y), groups, links))
    counts = Counter(link for *_, links in found for link in links)
    highest = {}
    for (own, _), n in counts.items():
        highest[own] = max(n, highest.get(own, 0))
    say = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(x, y, len(g), len(ls), sum(counts[k] == highest[k[0]] for k in ls), sum(counts[k] for k in ls), say(g)) for x, y, g, ls in found]


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    found = token_alignment.align(df, A_PATH, B_PATH, public_tokenizers.PATTERN, **more).collect()
    texts = [r[1] for r in rows]
    wanted = plain(texts)
    assert Counter(tuple(r) for r in found) == Counter((r[0], *w) for r, w in zip(rows, wanted, strict=True))


def test_against_loops(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "Übung", "naïve", "123", "x" * 40, "don't", "漢字", "🙂", "<|endoftext|>", "<s>", "<unk>", "\n\n", "  ", "\t", "É", "word", "▁", "\x00", "a.b,c"]
    rows = [(k, " ".join(rng.choices(words[:-3] if k % 4 else words, k=rng.randint(0, 30)))) for k in range(120)]
    rows += [(None, None), (None, "again and again"), (7, ""), (7, " "), (7, " "), (200, "same text"), (201, "same text"), (300, "word " * 5000), (301, "z" * 30_000), (302, " " * 3000)]
    monkeypatch.setattr(token_alignment, "BLOCK", 3000)  # many blocks
    monkeypatch.setattr(token_alignment, "HELD", 20_000)
    monkeypatch.setattr(runs, "FRAME", 7)
    check(spark, rows)


def test_query(spark, sf_dir):
    found = queries.op11_token_alignment(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = {r["doc_id"]: w for r, w in zip(docs, plain([r["text"] for r in docs]), strict=True)}
    for r in found:
        *numbers, groups = wanted[r["doc_id"]]
        assert [r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] == numbers
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert len(found) == len(docs)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None), (None, "")])


def test_pair_bound():
    with open(A_PATH, encoding="utf-8") as f, open(B_PATH, "rb") as g:
        pair = token_alignment.Pair(f.read(), g.read(), public_tokenizers.PATTERN)
    assert pair.pair_bound() < 1_000_000


@pytest.mark.parametrize("frame", [1, 5, 8192])
def test_runs(monkeypatch, frame):
    monkeypatch.setattr(runs, "FRAME", frame)
    rng, total, written = np.random.default_rng(1), Counter(), []
    for _ in range(6):
        keys = np.sort(rng.integers(0, 60, rng.integers(0, 80))) * 10**12
        members = np.concatenate([np.arange(n) for n in np.unique(keys, return_counts=True)[1]] or [np.zeros(0, int)])
        counts = rng.integers(1, 9, len(keys))
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            total[k] += n
        written.append(runs.write(keys, counts, members))
        own = [np.concatenate([f[j] for f in runs.read(written[-1])] or [np.zeros(0, int)]) for j in (1, 3)]
        assert (own[0] == counts).all() and (own[1] == members).all()
    whole = runs.merged([runs.merged(written[:3]), *written[3:]])
    assert {k: n for f in runs.totals(whole) for k, n in zip(*(x.tolist() for x in f), strict=True)} == total
    assert runs.merged([]) == b"" and runs.merged([b""]) == b""
