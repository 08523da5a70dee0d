"""Near-duplicate detection against an exact join of all pairs, on planted pairs at the threshold and on large groups."""

import random

import pytest

from foresift.llm import near_dedup
from foresift.llm.common import persist


def exact_components(rows):
    """Smallest id that links reach, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}, links


def edited(words, share, rng):
    """Words with about ``share`` of the five-word shingles changed, by single words far from each other."""
    out = list(words)
    for k in rng.sample(range(2, len(words) - 2, 5), round(share * len(words) / 5)):
        out[k] = f"new{rng.getrandbits(40)}"
    return out


def planted(seed):
    """Pairs around the threshold, chains, a star of copies of copies, and clean texts that share passages."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(5000)]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(40, 400))
        rows.append(words)
        rows.append(edited(words, rng.choice([0.10, 0.13, 0.14, 0.15, 0.16, 0.2]), rng))
        if rng.random() < 0.3:
            rows.append(edited(rows[-1], 0.12, rng))
        rows.append(rng.choices(vocabulary, k=rng.randint(30, 90)) + passage)
    centre = rng.choices(vocabulary, k=300)
    rows += [centre] + [edited(centre, rng.uniform(0.02, 0.25), rng) for _ in range(80)]
    rng.shuffle(rows)
    return [(k, " ".join(words)) for k, words in enumerate(rows)]


@pytest.mark.parametrize(("seed", "small", "star"), [(1, None, None), (2, None, None), (3, 24, 8)])
def test_recall_of_planted_pairs(spark, monkeypatch, seed, small, star):
    """No link is lost or made up; with small groups, large clusters go by stars and parts."""
    if small:
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "STAR", star)
    rows = planted(seed)
    want, links = exact_components(rows)
    docs = persist(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert links > 200
    wrong = {i for i in want if got[i] != want[i]}
    assert not wrong
