"""Byte-level BPE encoding and decoding with a frequent-word lexicon.

A mergeable frequent-items summary over the words of all texts names the frequent ones. Their ids are computed once
and compiled into a minimal acyclic transducer (lexicon.py), a file of bounded size that Spark ships to every
executor, where the workers memory-map it. A word outside the lexicon is merged exactly, by the vocabulary's merge
ranks. Every batch of texts is encoded where it lies: no shuffle.

A word here is what stands between two spaces, with the space before it. If a text has no space next to other white
space, nothing that the vocabulary's splitting pattern matches crosses a word's end, so words can be looked up whole;
other texts are split by the pattern first.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm.common import checkpoint_dir, frequent, lean, slices
from foresift.llm.lexicon import Lexicon, compile_lexicon

#: Lexicon bounds: words, the summary's counters, bytes a word.
WORDS, COUNTERS, WORD_BYTES = 10_000, 16_384, 48
#: A worker's memos of merged words are emptied beyond so many bytes.
MEMO = 24_000_000
#: Pieces of more bytes are merged one by one.
LONG = 48
#: Text handled at a time within a batch, in bytes.
SLICE = 600_000

# Fixed values of the public vocabulary format: white space by the Unicode property, and the splitting pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = _byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.merges, made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a] << 32) | ids[b], (rank, ids[a + b]))
            made.append(ids[a + b])
        self.none, self.made = len(made), np.array([*made, 0], np.int32)
        self.pair_keys = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.first_ids = np.array(self.byte_id, np.int32)
        self.first_ranks = self._ranks(np.repeat(self.first_ids, 256), np.tile(self.first_ids, 256))
        self.tokens = pa.array(self.bytes, pa.large_binary())

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; ``none`` where there is no such merge."""
        if not self.none:
            return np.zeros(a.shape, np.int32)
        keys = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(self.none))

    def merge_many(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of the splitting pattern, one after the other, and how many each piece has.

        ``raw`` has the bytes of all pieces, none of them empty, and ``starts`` where each begins. All pieces advance
        together: in each round every one that has a merge left does its lowest-ranked, leftmost one.
        """
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(raw))
        ids = self.first_ids[raw]
        ranks = np.append(self.first_ranks[(raw[:-1].astype(np.int32) << 8) | raw[1:]], np.int32(self.none))
        ranks[starts[1:] - 1] = self.none
        short = sizes <= LONG
        for k in np.flatnonzero(~short).tolist():
            merged = self._merge_long(ids[starts[k] : starts[k] + sizes[k]].tolist())
            ids[starts[k] : starts[k] + sizes[k]] = merged + [-1] * (int(sizes[k]) - len(merged))
        place = np.flatnonzero(np.repeat(short, sizes))  # of the bytes whose pieces go on, those that still begin a token
        ranks, left = ranks[place], sizes[short]
        while len(left):
            upto = np.cumsum(left)
            best = np.minimum.reduceat((ranks.astype(np.int64) << 32) | np.arange(len(ranks)), upto - left)
            live = best < self.none << 32
            keep = np.repeat(live, left)
            best, begin, end, left = best[live], (upto - left)[live], upto[live], left[live] - 1
            at, made = best & 0xFFFFFFFF, self.made[best >> 32]
            ids[place[at]], ids[place[at + 1]] = made, -1
            inner = at > begin
            ranks[at[inner] - 1] = self._ranks(ids[place[at[inner] - 1]], made[inner])
            inner = at + 2 < end
            ranks[at] = self.none
            ranks[at[inner]] = self._ranks(made[inner], ids[place[at[inner] + 2]])
            keep[at + 1] = False
            ranks, place = ranks[keep], place[keep]
        return ids[ids >= 0], np.add.reduceat(ids >= 0, starts, dtype=np.int64)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list, for time near linear in the length."""
        n, get = len(ids), self.merges.get
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (found := get((ids[k] << 32) | ids[after[k]])):
                heapq.heappush(heap, (found[0], k, found[1], ids[k], ids[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r] = made, -1
            after[k] = after[r]
            if after[r] >= 0:
                before[after[r]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]


class Coder:
    """Encodes texts to packed little-endian 32-bit ids, and decodes those."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = regex.compile(PATTERN).findall
        self.odd, self.edge = regex.compile(rf" [{SPACE}]|[{SPACE}] ").search, regex.compile(rf"^[{SPACE}]|[{SPACE}]\Z").search
        special = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(f"({special})") if special else None
        self.word, self.piece, self.held = {}, {}, 0

    def _learn(self, words: set[str], pieces: set[str]) -> None:
        """Put words (without the space before them) and pieces of the pattern into the memos, from the lexicon or else merged."""
        words, pieces = list(words), list(pieces - self.piece.keys())
        if self.lexicon and words:
            raw = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
            found = self.lexicon.find(raw, np.flatnonzero(raw == ord(" ")))
            self._keep(self.word, [w for w, ids in zip(words, found, strict=True) if ids is not None], [ids for ids in found if ids is not None])
            words = [w for w, ids in zip(words, found, strict=True) if ids is None]
        text = " " + " ".join(words) if words else ""
        cut = pieces + self.split(text)  # words begin and end without white space, so they are split side by side as each alone
        raw = np.frombuffer(("".join(pieces) + text).encode(), np.uint8)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.flatnonzero((raw & 0xC0) != 0x80)[np.cumsum(sizes) - sizes]
        ids, counts = self.vocabulary.merge_many(raw, starts)
        if words:
            first = np.flatnonzero(raw[starts[len(pieces) :]] == ord(" "))  # the piece that begins a word has its space
            counts = np.append(counts[: len(pieces)], np.add.reduceat(counts[len(pieces) :], first))
        packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        merged = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self._keep(self.piece, pieces, merged[: len(pieces)])
        self._keep(self.word, words, merged[len(pieces) :])

    def _keep(self, memo: dict[str, bytes], keys: list[str], ids: list[bytes]) -> None:
        memo.update(zip(keys, ids, strict=True))
        self.held += sum(map(len, keys)) + sum(map(len, ids)) + 200 * len(keys)  # what two objects and an entry take besides

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Special tokens in them get their own ids."""
        if self.held > MEMO:
            self.word.clear(), self.piece.clear()
            self.held = 0
        plans = []
        for text in texts:
            parts = self.special.split(text) if any(s in text for s in self.vocabulary.special) else [text]
            plans.append([self.vocabulary.packed[self.vocabulary.special[part]] if k % 2 else part.split(" ") for k, part in enumerate(parts)])
        runs = [x for plan in plans for x in plan if isinstance(x, list)]
        words = set().union(*[x[1:] for x in runs]) - self.word.keys()
        if words and self.odd(f" {' '.join(words)} "):
            odd = {w for w in words if not w or self.edge(w)}
            for x in runs:
                if not odd.isdisjoint(x[1:]):
                    x[:] = [" ".join(x)]
            words = set().union(*[x[1:] for x in runs]) - self.word.keys()
        firsts = []
        for x in runs:
            if len(x) > 1 and (not x[0] or self.edge(x[0])):
                x[:] = [" ".join(x)]
            firsts.append(self.split(x[0]))
        self._learn(words, set().union(*firsts))
        word, piece, first = self.word.__getitem__, self.piece.__getitem__, iter(firsts)
        return [b"".join([x if isinstance(x, bytes) else b"".join([*map(piece, next(first)), *map(word, x[1:])]) for x in plan]) for plan in plans]

    def decode(self, packed: list[bytes]) -> pa.Array:
        """The texts of packed ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = self.vocabulary.tokens.take(pa.array(np.frombuffer(b"".join(packed), "<u4")))
        _, ends, data = tokens.buffers()
        upto = np.cumsum([0, *map(len, packed)]) // 4
        ends = np.frombuffer(ends, np.int64)[upto] if len(tokens) else upto
        if ends[-1] < 1 << 31:
            texts = pa.StringArray.from_buffers(len(packed), pa.py_buffer(ends.astype(np.int32)), data)
            with contextlib.suppress(pa.ArrowInvalid):
                texts.validate(full=True)
                return texts
        data = memoryview(data or b"")
        return pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())


@functools.lru_cache(maxsize=1)
def _vocabulary(content: str) -> Vocabulary:
    """A worker keeps the last one for its next tasks."""
    return Vocabulary(content)


def frequent_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, WORDS at most, each with the space before it."""
    words = docs.select(F.explode(F.split(text_col, " ")).alias("w")).where(F.length("w").between(1, WORD_BYTES // 4) & ~F.col("w").rlike(rf"^[{SPACE}]|[{SPACE}]$"))
    return [" " + r["item"] for r in frequent(words, "w", WORDS, COUNTERS).collect()]


def ship(spark: SparkSession, content: bytes, kind: str) -> str:
    """Write a file of bounded size to the shared folder and have Spark copy it to every executor; its name there."""
    name = f"{kind}-{hashlib.sha256(content).hexdigest()[:24]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``id, ids`` (packed little-endian 32-bit) of every row, and with ``decode`` the text ``decoded`` from the ids.

    Null counts as the empty text, which has no ids. Every row gives one row, repeated or not; null ids stay null. An
    empty table gives an empty result. Only the two named columns are read. ``vocabulary_path`` is a tokenizer file
    that the driver reads.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coder, words = Coder(Vocabulary(content)), frequent_words(texts)
    lexicon_name = ship(spark, compile_lexicon({w.encode(): memoryview(ids).cast("I").tolist() for w, ids in zip(words, coder.encode(words), strict=True)}), "lexicon")
    vocabulary = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_vocabulary(vocabulary.value), Lexicon(SparkFiles.get(lexicon_name)))
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                ids = coder.encode(texts)
                columns = [batch.column(0)[at : at + len(texts)], pa.array(ids, pa.binary())]
                if decode:
                    columns.append(coder.decode(ids))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    kind = dict(texts.dtypes)["id"]
    return texts.mapInArrow(lean(run), f"id {kind}, ids binary" + ", decoded string" * decode)
