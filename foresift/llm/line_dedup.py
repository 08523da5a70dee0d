"""Removal of repeated passages by windows of lines.

A passage is neighbouring whole lines of ``LONG`` words or more together, the first and last of which hold words. At each
line with words starts, and at each ends, the shortest window of lines with so many words; which lines it takes depends on nothing but their texts. So any
passage that two texts share is covered, to its first and last line, by windows that they share. Shorter runs are found
by content-defined chunks: every line is hashed, and a rolling hash over the last two line hashes decides after which
lines a chunk ends. Windows, and chunks of several lines, that occur again anywhere in the table are removed but for
the first occurrence.

Digests only propose: before anything goes, the bytes are compared. A window's digest is that of its lines' digests, so
two windows are the same where both their sequences of lines' digests and the bytes behind each of these are. Every
occurrence of a repeated window gives both, equal ones collapse before and after the shuffle, and a digest behind which
two values are left was wrong: then all windows are keyed by their whole text instead.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import lean, removed, stored

#: One line in so many ends a chunk; words that make a passage, and a line a chunk of its own.
EVERY, LONG = 4, 50
#: Bytes of a window's digest (a line's has 16), and of what a task holds of compared lines.
DIGEST, PIECE = 20, 8_000_000


def chunks(text: str) -> list[tuple[str, bool]]:
    """The chunks of a text, in order, and whether each is subject to removal; joined by line feeds they are the text."""
    out: list[tuple[str, bool]] = []
    run: list[str] = []
    last = 0

    def close() -> None:
        if run:
            out.append(("\n".join(run), len(run) > 1 and any(x.strip() for x in run)))
            run.clear()

    for line in text.split("\n"):
        own = xxhash.xxh64_intdigest(line.encode())
        if len(line) >= 2 * LONG - 1 and len(line.split()) >= LONG:
            close()
            out.append((line, True))
        else:
            run.append(line)
            if xxhash.xxh64_intdigest(last.to_bytes(8, "little") + own.to_bytes(8, "little")) % EVERY == 0:
                close()
        last = own
    close()
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """First line and number of lines of what is subject to removal: all shortest windows of ``LONG`` words, and chunks."""
    found: set[tuple[int, int]] = set()
    upto = [0, *itertools.accumulate(len(line.split()) for line in text.split("\n"))]
    last = start = 0  # of the windows that start at a line, and that end at one
    for k in range(len(upto) - 1):
        if upto[k + 1] == upto[k]:  # however many lines without words follow each other, no window starts or ends at them
            continue
        while last < len(upto) and upto[last] - upto[k] < LONG:
            last += 1
        if last < len(upto):
            found.add((k, last - k))
        while upto[k + 1] - upto[start + 1] >= LONG:
            start += 1
        if upto[k + 1] - upto[start] >= LONG:
            found.add((start, k + 1 - start))
    at = 0
    for chunk, can_go in chunks(text):
        n = chunk.count("\n") + 1
        if can_go:
            found.add((at, n))
        at += n
    return sorted(found)


def _names(lines: list[str], size: int) -> list[bytes]:
    """A digest of every line."""
    return [hashlib.blake2b(line.encode(), digest_size=min(size, 16)).digest() for line in lines]


def _sequence(names: list[bytes]) -> bytes:
    """The digests of a window's lines, in order; a run of equal lines as one with its length."""
    return b"".join(name + sum(1 for _ in run).to_bytes(4, "big") for name, run in itertools.groupby(names))


def _keys(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From ``id, doc, text``: ``id, doc, k, n, key`` of the spans (``k, n``) that are subject to removal.

    ``key`` is a digest of ``size`` bytes of their lines' digests, or with size 0 their text.
    """
    for batch in batches:
        at, k, n, key = [], [], [], []
        for i, whole in enumerate(batch.column(2)):
            text = whole.as_py() or ""
            lines = text.split("\n")
            names = _names(lines, size) if size else []
            for start, count in spans(text):
                end = start + count
                name = hashlib.blake2b(_sequence(names[start:end]), digest_size=size).digest() if size else "\n".join(lines[start:end]).encode()
                at.append(i), k.append(start), n.append(count), key.append(name)
        rows = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.binary())], names=["id", "doc", "k", "n", "key"])


def _bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From ``text, spots``: what stands behind each digest, ``name, value``: a window's sequence of lines, a line's bytes; in pieces of some MB, each pair once a piece."""
    held, weight = {}, 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.binary()), pa.array([x for _, x in held], pa.binary())], names=["name", "value"])
        held.clear()
        return out

    for batch in batches:
        for whole, spots in zip(batch.column(0), batch.column(1), strict=True):
            lines = (whole.as_py() or "").split("\n")
            names = _names(lines, size)
            upto = 0  # lines before it have been given
            for k, n in sorted((s["k"], s["n"]) for s in spots.as_py()):
                sequence = _sequence(names[k : k + n])
                pairs = [(b"w" + hashlib.blake2b(sequence, digest_size=size).digest(), sequence)]
                pairs += [(b"l" + names[j], lines[j].encode()) for j in range(max(k, upto), k + n)]
                upto = max(upto, k + n)
                for pair in pairs:
                    if pair not in held:
                        held[pair] = None
                        weight += sum(map(len, pair)) + 100
                if weight > PIECE:
                    yield flush()
                    weight = 0
    yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``id, text, spots``: the text without the lines from ``go`` to the end of each spot, and counts."""
    for batch in batches:
        text, n, removed, chars = [], [], [], []
        for whole, gone in zip(batch.column(1), batch.column(2), strict=True):
            lines = (whole.as_py() or "").split("\n")
            kept, at, runs, cut = [], 0, 0, 0
            for first, end in sorted((g["go"], g["k"] + g["n"]) for g in gone.as_py() or () if g["go"] < g["k"] + g["n"]):
                if first > at or not runs:  # else it goes on with the run before
                    kept += lines[at:first]
                    runs, at, cut = runs + 1, first, cut - 1
                if end > at:
                    cut += sum(map(len, lines[at:end])) + end - at
                    at = end
            text.append("\n".join(kept + lines[at:]))
            n.append(len(chunks(whole.as_py() or ""))), removed.append(runs), chars.append(cut)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), *[pa.array(x, pa.int64()) for x in (n, removed, chars)]], names=["id", "text", "n_chunks", "n_removed", "removed_chars"])


def _spots(texts: DataFrame, kind: str, size: int) -> DataFrame:
    """``doc, spots``: each repeated window of a document, of which the lines from ``go`` on go (of a first occurrence, none)."""
    keys = stored(texts.mapInArrow(lean(functools.partial(_keys, size=size)), f"id {kind}, doc binary, k int, n int, key binary"))
    again = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "k", "doc")).alias("first")).where("m > 1").drop("m")
    same, end = F.col("doc") == F.col("first.doc"), F.col("k") + F.col("n")
    go = F.when(same & (F.col("k") == F.col("first.k")), end).when(same, F.greatest("k", F.col("first.k") + F.col("n"))).otherwise(F.col("k"))
    return keys.join(again, "key").select("doc", F.struct("k", "n", go.alias("go")).alias("g")).groupBy("doc").agg(F.collect_set("g").alias("spots"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: int = DIGEST) -> DataFrame:
    """``id, text, n_chunks, n_removed, removed_chars`` of every document; ``text`` is what stays of it.

    ``n_chunks`` counts the content-defined chunks, ``n_removed`` the runs of neighbouring lines that went and
    ``removed_chars`` their characters, with the line feeds inside them. The first occurrence of a passage is that in
    the smallest id (nulls first), then the earliest in the text; lines of an occurrence that overlaps it stay as far
    as they are part of it. Rows of equal id and text are one document, and each gets its answer. Null counts as the empty text. An empty table
    gives an empty result. Other columns are not read. Passages that begin or end within a line are found only as far
    as their whole lines go. The result does not depend on ``digest``, the bytes of a window's digest.

    Texts are shuffled once, to join the few marks of each document, and stored with them: bytes are compared, and lines cut, from there.
    """
    kind = dict(docs.dtypes)[id_col]
    i, t = F.col(id_col), F.col(text_col)
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    texts = docs.select(i.alias("id"), F.unhex(F.concat(half(F.xxhash64(i, t)), half(F.xxhash64(F.lit(1), t, i)))).alias("doc"), t.alias("text"))
    marked = lambda size: stored(texts.join(_spots(texts, kind, size), "doc", "left").select("id", "text", "spots"), "zstd")
    both = marked(digest)
    behind = both.where("spots IS NOT NULL").select("text", "spots").mapInArrow(lean(functools.partial(_bytes, size=digest)), "name binary, value binary")
    if not behind.distinct().groupBy("name").count().where("count > 1").isEmpty():
        removed(both)
        both = marked(0)
    return both.mapInArrow(lean(_cut), f"id {kind}, text string, n_chunks long, n_removed long, removed_chars long")
