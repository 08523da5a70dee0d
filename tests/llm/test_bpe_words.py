"""Words of all lengths are merged together, and every text has the library's ids."""

import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foresift.llm import bpe
from foresift.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", " \n ", "a\nb", "a\n\nb it's", "\ta", "a\t", "x y", "　", " a", "don't", "'ll", "we'Re", "12,345.6", "naïve", "日本語", "😀👍🏽", "<|endoftext|>", "<|endoftext", "\x1c", "\x85", "ab" * 300, "-" * 49, "é" * 25, "the", "The.", "\x00"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_words_of_all_lengths_advance_together(vocabulary, monkeypatch):
    """Each round looks up the pairs before and after the merges of all words; group by group it took hundreds of rounds."""
    rng, rounds, plain = random.Random(5), [], bpe.Vocabulary._ranks
    words = ["".join(rng.choices("etaoinshr", k=n)) for n in range(1, 45) for _ in range(20)]
    monkeypatch.setattr(bpe.Vocabulary, "_ranks", lambda self, a, b: (rounds.append(len(a)), plain(self, a, b))[1])
    bpe.Coder(vocabulary).encode([" ".join(words)])
    assert len(rounds) <= 2 * 48


def test_ids_and_texts_are_the_librarys(vocabulary, tmp_path):
    rng, library = random.Random(7), Tokenizer.from_file(PATH)
    made = lambda: "".join(rng.choices("etaoinshréß.,'1", k=rng.randint(1, 60)))
    texts = [*ODD, *[rng.choice(["", " "]) + rng.choice([" ", "", "\n"]).join(rng.choice([made(), made(), rng.choice(ODD)]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]]
    plain = bpe.Coder(vocabulary)
    known = sorted({w for t in texts[::3] for w in t.split(" ") if w and not plain.edge(w)})
    file = tmp_path / "lexicon"
    file.write_bytes(compile_lexicon({(" " + w).encode(): memoryview(ids).cast("I").tolist() for w, ids in zip(known, plain.encode([" " + w for w in known]), strict=True)}))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for lexicon in (None, Lexicon(file)):
        coder = bpe.Coder(vocabulary, lexicon)
        for at in range(0, len(texts), 100):
            got = coder.encode(texts[at : at + 100])
            assert got == [struct.pack(f"<{len(x)}I", *x) for x in want[at : at + 100]]
            assert coder.decode(got).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want[at : at + 100]]


def test_no_text_and_bytes_that_are_no_text(vocabulary):
    library, coder = Tokenizer.from_file(PATH), bpe.Coder(vocabulary)
    assert coder.encode([]) == [] and coder.encode(["", ""]) == [b"", b""]
    assert coder.decode([]).to_pylist() == [] and coder.decode([b"", b""]).to_pylist() == ["", ""]
    cut = library.encode("😀", add_special_tokens=False).ids
    rows = [cut[:1], cut[1:], [], cut, vocabulary.byte_id[0xC3:0xC4], vocabulary.byte_id[0xA9:0xAA]]
    assert coder.decode([struct.pack(f"<{len(x)}I", *x) for x in rows]).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in rows]


def test_the_lexicon_walks_many_words_at_a_time(tmp_path):
    import numpy as np

    words = {b" a": [1], b" ab": [2, 3], b" abc": [], b" b": [70_000], " é".encode(): [4]}
    file = tmp_path / "lexicon"
    for some in (words, {}):
        file.write_bytes(compile_lexicon(some))
        asked = [b" a", b" abcd", b" ab", b" x", b" abc", b" b", " é".encode(), b" \xc3"]
        raw = np.frombuffer(b"".join(asked), np.uint8)
        found = Lexicon(file).find(raw, np.flatnonzero(raw == 32))
        assert found == [struct.pack(f"<{len(some[w])}I", *some[w]) if w in some else None for w in asked]
