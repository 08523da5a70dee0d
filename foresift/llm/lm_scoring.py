"""Language-model scoring with a weighted backoff automaton.

A smoothed trigram model over words. Its states are the contexts: the empty one, each word and each word pair that was
trained on. An arc of a context carries the log-probability of a word that was seen after it and leads to the longest
context that ends there; where there is no arc, the failure arc leads to the context without its first word, at the
cost of the backoff weight. One left-to-right traversal carries the state and adds up the log-probabilities.

Counts are smoothed by Dirichlet priors: ``p(w | c) = (n(c w) + prior * p(w | shorter c)) / (n(c) + prior)``, so a
model is counts of word runs and nothing else. It grows with the corpus and is never gathered in one place. The rows
of an input partition are cut into blocks of bounded text. Each block counts its own runs of one, two and three words,
as 64-bit hashes; the hashes are dealt to buckets by their range, and a block sends each bucket one packed row. The
bucket adds up and sends back the totals in the same order, without the hashes, which the block can tell again. From
them it compiles its part of the automaton. A frequent run is one entry a block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import give_back, lean, stored

#: Words in a run at most; the prior's weight, in tokens, of contexts of one and of two words.
ORDER, PRIOR = 3, (100.0, 10.0)
#: Characters of text in a block, and for each bucket, about. Tokens that are traversed in one go; the state at a cut is that of the tokens before it.
BLOCK, BUCKET, SEGMENT = 8_000_000, 6_000_000, 512
END = b" end"  # no word holds a space


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 1


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end token."""
    return [*text.encode().lower().split(), END]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bool], list[str]]]:
    """Cut a partition's (id, held_out, text) rows, in their order, into (block, ids, held out, texts)."""
    part, k, held = TaskContext.get().partitionId(), 0, 0
    ids, out, texts = [], [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for i, o, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                ids.append(i), out.append(o), texts.append(t or "")
                held += len(texts[-1]) + 64
                if held >= BLOCK:
                    yield (part << 20) + k, ids, out, texts
                    ids, out, texts, held, k = [], [], [], 0, k + 1
    if ids:
        yield (part << 20) + k, ids, out, texts


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Block:
    """A block's runs of words.

    Of runs of n words, ``keys[n - 1]`` has the sorted different hashes, ``last[n - 1]`` a position where each ends,
    ``of[n - 1]`` for each position the number of the run that ends there (-1: the text has fewer words up to it), and
    ``counts[n - 1]`` how often each ends in a training text. ``ends`` and ``lengths`` are those of the texts.
    """

    def __init__(self, texts: list[str], held_out: list[bool]):
        known, flat, lengths = _Hashes(), [], []
        for t in texts:
            words = tokens(t)
            flat.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            lengths.append(len(words))
        one, self.lengths = np.concatenate(flat), np.array(lengths)
        flat.clear()
        self.ends = np.cumsum(self.lengths)
        depth = np.arange(len(one)) - np.repeat(self.ends - self.lengths, self.lengths)
        trained = np.repeat(~np.array(held_out, bool), self.lengths)
        run = one
        self.keys, self.last, self.of, self.counts = [], [], [], []
        for n in range(ORDER):
            at = np.flatnonzero(depth >= n)
            if n:
                before = run
                run = np.zeros(len(one), np.uint64)
                run[at] = _mix(before[at - 1] * np.uint64(0x9E3779B97F4A7C15) + one[at])
            keys, first, inverse = np.unique(run[at], return_index=True, return_inverse=True)
            of = np.full(len(one), -1, np.int64)
            of[at] = inverse
            self.keys.append(keys), self.last.append(at[first]), self.of.append(of)
            self.counts.append(np.bincount(inverse, weights=trained[at], minlength=len(keys)).astype(np.int64))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted hashes: the buckets they fall in, where each of those starts, and 48 more bits of each hash within its bucket, in order."""
    b = np.uint64(buckets)
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    bucket = (high * b + (low * b >> np.uint64(32))) >> np.uint64(32)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]) if len(keys) else np.zeros(0, np.int64)
    return bucket[starts].astype(np.int64), starts, keys * b >> np.uint64(16)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as gaps of as many bytes as the widest needs, which the first byte tells."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    width = raw[0]
    gaps = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow in full."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def unpack_counts(raw: bytes, size: int) -> np.ndarray:
    short = np.frombuffer(raw, np.uint8, size)
    out = short.astype(np.int64)
    out[short == 255] = np.frombuffer(raw, "<i8", offset=size)
    return out


def _xor(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(keys, starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)


def _total(rows: pa.Table) -> pa.Table:
    """Of one bucket's rows: the totals over all blocks of each block's runs, and the sum and number of those trained on."""
    runs = [unpack_sorted(x.as_py()) for x in rows["runs"]]
    sizes = [len(x) for x in runs]
    counts = np.concatenate([unpack_counts(x.as_py(), n) for x, n in zip(rows["counts"], sizes, strict=True)])
    different, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(different)).astype(np.int64)
    each = np.split(total[inverse], np.cumsum(sizes)[:-1])
    once = lambda x: pa.array([int(x), *[0] * (len(sizes) - 1)], pa.int64())
    out = [rows["block"], rows["slot"], rows["mark"], pa.array([pack_counts(x) for x in each], pa.binary()), once(total.sum()), once((total > 0).sum())]
    del runs, counts, inverse, different, each
    give_back()
    return pa.Table.from_arrays(out, names=["block", "slot", "mark", "totals", "n", "v"])


class Automaton:
    """A block's part of the model.

    State 0 is the empty context, then come the block's words, then its word pairs; a run that was not trained on has
    no arcs, and its failure arc costs nothing. ``arcs`` are sorted numbers of state and word, with their ``weight``
    (log10 of the probability) and ``target``; ``fail`` and ``backoff`` are the failure arcs and their weights.
    """

    def __init__(self, b: _Block, totals: list[np.ndarray], below: float):
        self.n_words = words = len(b.keys[0])
        first = [np.zeros(len(k), np.int64) if not n else b.of[n - 1][last - 1] for n, (k, last) in enumerate(zip(b.keys, b.last, strict=True))]
        rest = [np.zeros(len(k), np.int64) if not n else b.of[n - 1][last] for n, (k, last) in enumerate(zip(b.keys, b.last, strict=True))]
        start = [0, 1, 1 + words]  # the first state of contexts of 0, 1 and 2 words
        self.unigram = np.log10((totals[0] + 0.5) / below)
        p, arcs, weight, target = 10.0**self.unigram, [], [], []
        self.fail, self.backoff = [np.zeros(1, np.int64)], [np.zeros(1)]
        for n in range(1, ORDER):
            context, prior = totals[n - 1], PRIOR[n - 1]
            self.fail.append(start[n - 1] + rest[n - 1])
            self.backoff.append(np.log10(prior / (context + prior)))
            p = (totals[n] + prior * p[rest[n]]) / (context[first[n]] + prior)
            seen = np.flatnonzero(totals[n] > 0)
            arcs.append((start[n] + first[n][seen]) * words + b.of[0][b.last[n][seen]])
            weight.append(np.log10(p[seen]))
            ends_in = seen if n + 1 < ORDER else rest[n][seen]
            target.append(start[min(n + 1, ORDER - 1)] + ends_in)
        order = [np.argsort(x) for x in arcs]
        # runs of n words leave states of n - 1 words only, all of which come before those of n words
        self.arcs, self.weight, self.target = (np.concatenate([x[o] for x, o in zip(part, order, strict=True)]) for part in (arcs, weight, target))
        self.fail, self.backoff = np.concatenate(self.fail), np.concatenate(self.backoff)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the arc of each word, or failure arcs until there is one: the weights, and the next states."""
        cost, target, state = np.zeros(len(word)), 1 + word, state.copy()
        open_ = np.flatnonzero(state > 0)
        while len(open_):
            arc = state[open_] * self.n_words + word[open_]
            k = np.minimum(np.searchsorted(self.arcs, arc), max(len(self.arcs) - 1, 0))
            hit = self.arcs[k] == arc if len(self.arcs) else np.zeros(len(arc), bool)
            done, k = open_[hit], k[hit]
            cost[done] += self.weight[k]
            target[done], state[done] = self.target[k], -1
            open_ = open_[~hit]
            cost[open_] += self.backoff[state[open_]]
            state[open_] = self.fail[state[open_]]
            open_ = open_[state[open_] > 0]
        last = state == 0
        cost[last] += self.unigram[word[last]]
        return cost, target


def traverse(b: _Block, model: Automaton, totals: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each token. Texts are cut into segments, which all advance one token at a time."""
    word, pair, out = b.of[0], b.of[1], np.empty(len(b.of[0]))
    cuts = np.concatenate([np.arange(e - n, e, SEGMENT) for e, n in zip(b.ends, b.lengths, strict=True)])
    ends = np.minimum(cuts + SEGMENT, np.repeat(b.ends, -(-b.lengths // SEGMENT)))
    by_pair = (pair[cuts - 1] >= 0) & (np.append(totals[1], 0)[pair[cuts - 1]] > 0)
    state = np.where(by_pair, 1 + model.n_words + pair[cuts - 1], 1 + word[cuts - 1])
    state[np.isin(cuts, b.ends - b.lengths)] = 0
    by_length = np.argsort(cuts - ends, kind="stable")  # the longest first, so that the running ones are a prefix
    cuts, lengths, state = cuts[by_length], (ends - cuts)[by_length], state[by_length]
    for k in range(lengths[0] if len(lengths) else 0):
        running = np.searchsorted(-lengths, -k, side="left")
        at = cuts[:running] + k
        out[at], state[:running] = model.step(state[:running], word[at])
    return out


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows whose crc32 of the id as text, modulo 5, is not 1; a null id counts as the empty
    text. Null and empty texts are one end token. Repeated rows count as often as they occur. Scores are log10
    probabilities; ``base_score`` is that of the smoothed unigram alone. Without training tokens every token is unknown.
    An empty table gives an empty result. Only the two named columns are read. ``docs`` should be a stored table, whose
    partitions are the same each time they are read; a change is noticed and raises. Runs of words are told apart by
    48 bits of their hash beside the bucket's number.
    """
    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("out"), F.col(text_col).alias("text"))
    chars = texts.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    buckets = int(chars // BUCKET) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, out, rows in _blocks(batches):
            b = _Block(rows, out)
            rows.clear()  # the texts are not needed beside their hashes
            for n, (keys, counts) in enumerate(zip(b.keys, b.counts, strict=True)):
                bucket, starts, values = _dealt(keys, buckets)
                ends = [*starts[1:], len(keys)]
                packed = [[f(x[s:e]) for s, e in zip(starts, ends, strict=True)] for f, x in ((pack_sorted, values), (pack_counts, counts))]
                columns = [pa.array(np.full(len(starts), block)), pa.array(n * buckets + bucket), pa.array(_xor(keys, starts)), *[pa.array(x, pa.binary()) for x in packed]]
                for at in range(0, len(starts), 1000):
                    yield pa.RecordBatch.from_arrays([c[at : at + 1000] for c in columns], names=["block", "slot", "mark", "runs", "counts"])

    totals = texts.mapInArrow(lean(count), "block long, slot long, mark long, runs binary, counts binary")
    totals = stored(totals.groupBy("slot").applyInArrow(_total, "block long, slot long, mark long, totals binary, n long, v long"), "zstd")
    n_train, vocabulary = totals.where(F.col("slot") < buckets).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    below = n_train + 0.5 * (vocabulary + 1)
    id_kind, id_type = dict(texts.dtypes)["id"], texts.select("id").limit(0).toArrow().schema.field(0).type
    packing = pa.schema([("id", id_type), ("out", pa.bool_()), ("text", pa.string())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, out, rows in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, packing, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(out), pa.array(rows, pa.string())], schema=packing))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    def score(placed: pa.Table, model: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(placed["rows"][0].as_buffer()).read_all()
        b = _Block(rows["text"].to_pylist(), rows["out"].to_pylist())
        order = np.argsort(model["slot"].to_numpy())
        slot, mark = model["slot"].to_numpy()[order], model["mark"].to_numpy()[order]
        totals, at = [], 0
        for n, keys in enumerate(b.keys):
            bucket, starts, _ = _dealt(keys, buckets)
            here = slice(at, at + len(starts))
            if not (np.array_equal(slot[here], n * buckets + bucket) and np.array_equal(mark[here], _xor(keys, starts))):
                raise RuntimeError("the table's partitions changed between two reads; store it first")
            sizes = np.diff([*starts, len(keys)])
            totals.append(np.concatenate([np.zeros(0, np.int64), *[unpack_counts(model["totals"][int(k)].as_py(), s) for k, s in zip(order[here], sizes, strict=True)]]))
            at += len(starts)
        automaton = Automaton(b, totals, below)
        sums = lambda x: pa.array(np.add.reduceat(x, b.ends - b.lengths))
        out = [rows["id"], rows["out"], pa.array(b.lengths.astype(np.int64)), sums((totals[0] > 0).astype(np.int64)[b.of[0]]), pa.array(np.full(len(b.lengths), n_train))]
        out += [sums(automaton.unigram[b.of[0]]), sums(traverse(b, automaton, totals))]
        del b, automaton, totals
        give_back()
        return pa.Table.from_arrays(out, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    placed = texts.mapInArrow(lean(place), "block long, rows binary")
    return placed.groupBy("block").cogroup(totals.select("block", "slot", "mark", "totals").groupBy("block")).applyInArrow(score, f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
