"""How the tokens of two tokenizers line up in the same texts, and which pairs of them end together most.

One pass over the texts encodes a block at a time with both tokenizers and cuts both rows of tokens where they end at the
same byte. A block becomes one row: what is known of each document, and its pair-document records, dealt by radix of the
B id to sorted runs of zstd frames. Where the runs lie they are merged by a heap of cursors into counts of pairs, and those
of all partitions in a tree, by radix. Keys have the B id in front, so one walk over the counts knows the highest
of each B id. A last pass walks every block's runs beside the counts and gives each document its share: the records
themselves are never shuffled. Of two tokens that end together the shorter is a suffix of the longer, so the two
vocabularies bound the pairs (``pair_bound``): the table of counts is shipped to all executors as one file.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.llm import runs
from foresift.llm.bpe import Vocabulary, ship
from foresift.llm.common import FAN_IN, lean, slices, stored

#: Text handled at a time, in bytes, and parts of the records, by the last bits of the B id.
BLOCK, RADIX = 3_000_000, 16
#: Runs merged at a time: compressed bytes held before they become counts.
HELD = 48_000_000
#: Bits of an id, and of a document's place in its block.
ID_BITS, PLACE_BITS = 18, 20


class Pair:
    """Two tokenizers: A a byte-level vocabulary file, B a sentencepiece model."""

    def __init__(self, a: str, b: bytes, pattern: str):
        spec, vocabulary = json.loads(a), Vocabulary(a)
        special = {t["id"] for t in spec.get("added_tokens", ())}
        ranks = {raw: i for i, raw in enumerate(vocabulary.bytes) if raw and i not in special}
        made = [vocabulary.made[r] for r in range(vocabulary.none)]
        if any(x > y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("the vocabulary's merges are not in the order of its ids")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = vocabulary.bytes
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if max(len(self.a_bytes), len(self.b_bytes)) >= 1 << ID_BITS:
            raise ValueError("a vocabulary is too large")
        self.pieces = [pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes)]
        last = lambda n, mark: [f"{i}{m}" for i in range(n) for m in (",", mark)]
        self.names = pa.array(last(len(self.a_bytes), "|") + last(len(self.b_bytes), ";"), pa.large_string())

    def pair_bound(self) -> int:
        """How many pairs of ids can end together: one of the two is the other's suffix."""
        a, b = Counter(filter(None, self.a_bytes)), Counter(filter(None, self.b_bytes))
        ends = lambda raw: (raw[k:] for k in range(len(raw)))
        return sum(n * b[s] for raw, n in a.items() for s in ends(raw)) + sum(n * a[s] for raw, n in b.items() for s in ends(raw) if s != raw)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both tokenizers, one array each for all texts with the number of every text's; texts that do not join to themselves have none."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        sizes, found = np.array([len(r) for r in raw]), []
        for side, encode in enumerate((lambda t: self.a.encode_ordinary(" " + t), self.b.encode)):
            lists = [encode(t) if t else [] for t in texts]
            ids, counts = np.fromiter((i for x in lists for i in x), np.int64), np.array([len(x) for x in lists], np.int64)
            joined = self.pieces[side].take(pa.array(ids))
            ends = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
            data = memoryview(joined.buffers()[2] or b"").cast("B")
            upto = ends[np.append(0, np.cumsum(counts))]
            found.append((ids, counts, np.array([upto[k + 1] - upto[k] == len(r) and data[upto[k] : upto[k + 1]] == r for k, r in enumerate(raw)], bool)))
        good = found[0][2] & found[1][2]
        return *[[ids[np.repeat(good, counts)], np.where(good, counts, 0)] for ids, counts, _ in found], np.where(good, sizes, 0)


@functools.lru_cache(maxsize=2)
def _pair(a: str, b: str, pattern: str) -> Pair:
    return Pair(a, base64.b64decode(b), pattern)


def aligned(pair: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text, its groups as text, and the pair-document records: keys (radix, B id, A id), places, counts, in order."""
    (a, n_a), (b, n_b), sizes = pair.tokens(texts)
    lengths = [np.array([len(x) for x in raw], np.int64) for raw in (pair.a_bytes, pair.b_bytes)]
    ends_a, ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
    at = np.zeros((2, int(sizes.sum()) + 1), bool)
    at[0, ends_a], at[1, ends_b] = True, True
    cut_a, cut_b = at[1, ends_a], at[0, ends_b]
    link_a, link_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    place = np.searchsorted(np.cumsum(sizes), ends_a[link_a], "left")
    n_groups = np.bincount(place, minlength=len(texts))
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    order = np.empty(len(a) + len(b), np.int64)  # the names of all tokens, group after group
    order[np.arange(len(a)) + np.append(0, link_b + 1)[group_a]] = 2 * a + cut_a
    order[np.arange(len(b)) + (link_a + 1)[group_b]] = 2 * (len(pair.a_bytes) + b) + cut_b
    said = pair.names.take(pa.array(order))
    starts = np.frombuffer(said.buffers()[1], np.int64, len(order) + 1) if len(order) else np.zeros(1, np.int64)
    data, bounds = memoryview(said.buffers()[2] or b""), starts[np.append(0, np.cumsum(n_a + n_b))].tolist()
    groups = [str(data[x : max(x, y - 1)], "ascii") for x, y in zip(bounds, bounds[1:], strict=False)]
    x, y = a[link_a], b[link_b]
    packed, counts = np.unique((((((y % RADIX) << ID_BITS | y // RADIX) << ID_BITS) | x) << PLACE_BITS) | place, return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups}, groups, packed >> PLACE_BITS, packed & ((1 << PLACE_BITS) - 1), counts


def _blocks(docs: DataFrame, a: str, b: str, pattern: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """A row a block: ids, counts and groups (or their digests) of its documents, and a run of records for each radix."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"ids array<{dict(rows.dtypes)['id']}>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, runs array<binary>"
    shared, size = docs.sparkSession.sparkContext.broadcast((a, b, pattern)), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*shared.value)
        for batch in batches:
            for at, texts in slices(batch.column(1), size):
                counts, groups, keys, places, n = aligned(pair, texts)
                if not with_groups:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                cuts = np.searchsorted(keys, [r << 2 * ID_BITS for r in range(RADIX + 1)])
                parts = [runs.write(keys[x:y], n[x:y], places[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                ids = batch.column(0)[at : at + len(texts)]
                yield pa.RecordBatch.from_arrays([one(ids), *[one(pa.array(c, pa.int64())) for c in counts.values()], one(pa.array(groups, pa.string())), one(pa.array(parts, pa.binary()))], names=["ids", *counts, "groups", "runs"])

    return rows.mapInArrow(lean(run), schema)


def _counts(blocks: DataFrame) -> DataFrame:
    """``radix, run``: the counts of all pairs, one run a radix, merged where the records lie and then in a tree."""
    schema, most = "part long, radix int, run binary", HELD

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in range(RADIX)]
        for batch in batches:
            for parts in batch.column(1).to_pylist():
                for r, part in enumerate(parts):
                    held[r].append(part)
                if sum(map(len, (p for h in held for p in h))) > HELD:
                    held = [[runs.merged(h)] for h in held]
            part = batch.column(0)[0].as_py() if batch.num_rows else None
        if any(held):
            yield pa.RecordBatch.from_pydict({"part": [part] * RADIX, "radix": list(range(RADIX)), "run": [runs.merged(h) for h in held]}, schema=pa.schema([("part", pa.int64()), ("radix", pa.int32()), ("run", pa.binary())]))

    def combined(group: pa.Table) -> pa.Table:
        return pa.table({"part": group["part"][:1], "radix": group["radix"][:1], "run": pa.array([runs.merged(group["run"].to_pylist())], pa.binary())})

    found = stored(blocks.select(F.spark_partition_id().cast("long").alias("part"), "runs").mapInArrow(lean(local), schema))
    left = found.agg(F.max("part")).first()[0] or 0
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "radix").applyInArrow(combined, schema)
        if (left := left // FAN_IN) == 0:
            return found


def pair_counts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all pairs that end together (radix, B id, A id), ascending; their counts; whether a count is its B id's highest.

    The two vocabularies bound the number of pairs (``Pair.pair_bound``), so the driver can hold them.
    """
    found = sorted(_counts(blocks).select("radix", "run").collect())
    frames = [f for _, run in found for f in runs.totals(bytes(run))]
    keys, counts = (np.concatenate([f[k] for f in frames] or [np.zeros(0, np.int64)]) for k in (0, 1))
    if not len(keys):
        return keys, counts, np.zeros(0, bool)
    starts = np.flatnonzero(np.diff(keys >> ID_BITS, prepend=-1))
    highest = np.maximum.reduceat(counts, starts)
    return keys, counts, counts == np.repeat(highest, np.diff(np.append(starts, len(keys))))


@functools.lru_cache(maxsize=2)
def _table(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    A (a byte-level vocabulary file, with its splitting ``pattern``) encodes a space and the text, B (a sentencepiece model)
    the text, to which it adds a space; strings of special tokens are plain text. ``groups`` has the ids, cut wherever both
    end at the same byte, as ``a1,a2|b1;a3|b2,b3``; without ``with_groups`` its SHA-256. Each end is a link between the two
    tokens that end there. A pair's count is how often its ids are linked in all rows; ``n_best`` counts a row's links whose
    count is the highest of their B id, ties included, and ``count_sum`` adds up the counts of all its links.

    Null and empty texts, and those whose A or B tokens do not join to the same bytes, have zeros and empty groups. Every
    row gives one row, repeated or not; null ids stay null; an empty table gives an empty result. Only the two named columns
    are read. No token is the empty string, so one A and one B token end at a place at most.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        a, b = f.read(), base64.b64encode(g.read()).decode()
    blocks = stored(_blocks(docs, a, b, pattern, id_col, text_col, with_groups), "uncompressed" if not with_groups else "zstd")
    keys, counts, best = pair_counts(blocks)
    file = io.BytesIO()
    np.save(file, np.stack([keys, counts, best]))
    name = ship(spark, file.getvalue(), "pairs")
    kind = dict(blocks.dtypes)["ids"][6:-1]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, best = _table(SparkFiles.get(name))
            for row in range(batch.num_rows):
                ids, n_a, n_b, n_groups, groups, parts = (batch.column(k)[row].values for k in range(6))
                shares = np.zeros((2, len(ids)), np.int64)
                for part in parts.to_pylist():
                    for own, n, sizes, places in runs.read(part):
                        at = np.repeat(np.searchsorted(keys, own), sizes)  # both ascend
                        np.add.at(shares[0], places, n * best[at])
                        np.add.at(shares[1], places, n * counts[at])
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, n_groups, n_groups, pa.array(shares[0]), pa.array(shares[1]), groups], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return blocks.mapInArrow(lean(share), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
