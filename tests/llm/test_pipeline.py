"""Every stage of the pipeline, and the whole, against plain Python on a small documents table with edge rows."""

import hashlib
import struct
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dedup import edited, exact_components, planted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    import random

    rng = random.Random(9)
    rows = [(i, text, ("en", "de")[i % 2], f"s{i % 5}" if i % 11 else None) for i, text in planted(4)[:120]]
    base = rng.choices([f"w{k}" for k in range(900)], k=4000)
    rows += [(500, " ".join(base), "en", "s1"), (501, " ".join(edited(base, 0.1, rng)), "en", "s2"), (502, " ".join(base).upper(), None, "s1")]
    rows += [(503, None, "en", "s1"), (504, "", "de", "s2"), (505, "12 34 !", None, None), (506, "Éa", "de", "s3"), (506, "Éa", "de", "s3"), (507, "éA", "de", "s3"), (508, "Éa  more\n\nlines\n", "en", "s4")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark, sf_dir, tmp_path):
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def after(name, docs):
        found = stages[name](spark, docs, sf_dir)
        found.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    kept = after("language id", docs)
    want = [r for r in table() if any(c.isalpha() for c in r[1] or "")]
    assert kept.columns == columns and Counter(map(tuple, kept.collect())) == Counter(want)

    one = after("exact dedup", kept)
    best = {}
    for r in want:
        best[low(r[1])] = max(best.get(low(r[1]), r), r, key=lambda x: x[0])
    assert one.columns == columns and Counter(map(tuple, one.collect())) == Counter(best.values())

    near = after("near dedup", one)
    component, links = exact_components([(r[0], low(r[1])) for r in best.values()])
    want = [r for r in best.values() if component[r[0]] == r[0]]
    assert links > 50 and near.columns == columns and Counter(map(tuple, near.collect())) == Counter(want)

    mixed = after("mixing", near)
    taken = Counter(map(tuple, mixed.collect()))
    size = {r: len(r[1].split()) for r in want}
    assert mixed.columns == columns and set(taken) <= set(want) and max(taken.values()) <= 2
    assert 1.3 < sum(size[r] * n for r, n in taken.items()) / sum(size.values()) < 1.6  # the targets are 150 % in all

    coded = stages["bpe"](spark, mixed, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    want = Counter()
    for r, n in taken.items():
        ids = library.encode(r[1], add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[r[0], len(ids), packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in coded) == want

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole) == Counter((r["doc_id"], r["ids_sha256"]) for r in coded)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
