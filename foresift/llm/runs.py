"""Sorted runs of counted keys as zstd frames, and their merge by a heap of cursors.

A run is bytes: frames of up to ``FRAME`` keys, each after its length in four bytes. A frame has the keys in ascending
order and, for every key, either one count or a list of members with a count each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import zstandard

FRAME = 8_192


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join([len(a).to_bytes(4, "little") + a.dtype.str[1:].encode() + a.tobytes() for a in arrays])
    frame = zstandard.ZstdCompressor(level=1).compress(raw)
    return len(frame).to_bytes(4, "little") + frame


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers, none below 0, in the least type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def write(keys: np.ndarray, counts: np.ndarray, members: np.ndarray | None = None) -> bytes:
    """A run of ascending keys. With ``members`` a key may recur: once for each member, those in ascending order."""
    if members is None:
        cuts = range(0, len(keys), FRAME)
        return b"".join([_packed(_narrow(np.diff(keys[k : k + FRAME], prepend=0)), _narrow(counts[k : k + FRAME])) for k in cuts])
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    bounds, out = np.append(starts, len(keys)), []
    for k in range(0, len(starts), FRAME):
        at, end = bounds[k], bounds[min(k + FRAME, len(starts))]
        sizes = np.diff(bounds[k : k + FRAME + 1])
        out.append(_packed(_narrow(np.diff(keys[starts[k : k + FRAME]], prepend=0)), _narrow(counts[at:end]), _narrow(sizes), _narrow(members[at:end])))
    return b"".join(out)


def read(run: bytes) -> Iterator[list[np.ndarray]]:
    """The frames of a run: keys and counts, or keys, counts of all members, members of each key, members."""
    at = 0
    while at < len(run):
        end = at + 4 + int.from_bytes(run[at : at + 4], "little")
        raw, k, arrays = zstandard.ZstdDecompressor().decompress(run[at + 4 : end]), 0, []
        while k < len(raw):
            n, kind = int.from_bytes(raw[k : k + 4], "little"), np.dtype(raw[k + 4 : k + 6].decode())
            arrays.append(np.frombuffer(raw, kind, n, k + 6).astype(np.int64))
            k += 6 + n * kind.itemsize
        arrays[0] = np.cumsum(arrays[0])
        yield arrays
        at = end


def totals(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frames of a run as keys with one count each."""
    for keys, counts, *rest in read(run):
        yield keys, np.add.reduceat(counts, np.cumsum(rest[0]) - rest[0]) if rest else counts


def merge(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all runs in ascending order, each once with its whole count. One frame of every run is open at a time.

    The heap has each run's cursor by the last key of its open frame: up to the least of these all keys are at hand.
    """
    cursors = [totals(r) for r in runs]
    opened, heap = [next(c, None) for c in cursors], []
    for k, frame in enumerate(opened):
        if frame:
            heapq.heappush(heap, (int(frame[0][-1]), k))
    while heap:
        upto, parts = heap[0][0], []
        for _, k in heap:
            keys, counts = opened[k]
            if keys[0] <= upto:
                n = int(np.searchsorted(keys, upto, "right"))
                parts.append((keys[:n], counts[:n]))
                opened[k] = keys[n:], counts[n:]
        while heap and heap[0][0] == upto:
            k = heapq.heappop(heap)[1]
            opened[k] = next(cursors[k], None)
            if opened[k]:
                heapq.heappush(heap, (int(opened[k][0][-1]), k))
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        yield keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def merged(runs: list[bytes]) -> bytes:
    """The merge as a run. Frames of a few keys are put together."""
    out, held = [], []
    for part in merge(runs):
        held.append(part)
        if sum(len(k) for k, _ in held) >= FRAME:
            out.append(write(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))
            held = []
    if held:
        out.append(write(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))
    return b"".join(out)
