"""What encoding holds at a time is bounded by its slices, not by the batch."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa

from foresift.llm import bpe
from foresift.llm.common import slices


def test_a_batch_is_encoded_in_little_memory():
    """Lists of the words of a batch of 4 MB would take some 30 MB."""
    rng = random.Random(3)
    words = [f"{chr(97 + k % 26)}{k}" for k in range(2000)]
    texts = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(2000)])
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary(f.read()))
    coder.encode([" ".join(words)])
    tracemalloc.start()
    try:
        n = sum(len(coder.encode(some)) for _, some in slices(texts, bpe.SLICE))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000
    assert peak < 20_000_000


def test_memos_are_emptied_before_they_grow_large():
    """200,000 words would take some 43 MB."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary(f.read()))
    most = 0
    for k in range(40):
        coder.encode([" ".join(f"w{5000 * k + j:x}" for j in range(5000))])
        most = max(most, coder.held)
    assert most < 30_000_000
