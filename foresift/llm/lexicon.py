"""A minimal acyclic transducer from words to id sequences, in one flat file that readers memory-map.

States with equal futures are one state, so common suffixes are stored once. Every arc carries the number of words
that sort before those it leads to; the sum along a path is the word's rank, which finds its ids. The file is a
run of little-endian 32-bit integers:

    n_states, n_arcs, n_words, n_ids,
    first arc of each state (n_states + 1), is final (n_states),
    label, target, addend of each arc (n_arcs each), first id of each word (n_words + 1), ids (n_ids)
"""

from __future__ import annotations

import mmap
from array import array

import numpy as np


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file's content for the given words; the root is state 0."""
    registry: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)), targets before their sources
    reach: list[int] = []  # words accepted from each state

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
            reach.append(node[0] + sum(reach[t] for _, t in node[1]))
        return registry[key]

    path: list[list] = [[0, []]]  # unfrozen nodes along the last word
    before = b""
    for word in sorted(words):
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        for depth in range(len(before), same, -1):
            path[depth - 1][1].append((before[depth - 1], freeze(path.pop())))
        path += [[0, []] for _ in word[same:]]
        path[-1][0] = 1
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][1].append((before[depth - 1], freeze(path.pop())))
    root = freeze(path[0])

    order = [root, *(s for s in range(len(states)) if s != root)]
    number = {s: k for k, s in enumerate(order)}
    first, final, label, target, addend = array("i", [0]), array("i"), array("i"), array("i"), array("i")
    for s in order:
        total = states[s][0]
        final.append(states[s][0])
        for c, t in states[s][1]:
            label.append(c)
            target.append(number[t])
            addend.append(total)
            total += reach[t]
        first.append(len(label))
    start, ids = array("i", [0]), array("i")
    for word in sorted(words):
        ids.extend(words[word])
        start.append(len(ids))
    head = array("i", [len(order), len(label), len(words), len(ids)])
    return b"".join(x.tobytes() for x in (head, first, final, label, target, addend, start, ids))


class Lexicon:
    """Looks words up in the mapped file, whose pages all readers on a machine share; only the arcs' keys are a reader's own."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole = np.frombuffer(self.map, "<i4")
        n_states, n_arcs, n_words, n_ids = whole[:4].tolist()
        parts, at = [], 4
        for n in (n_states + 1, n_states, n_arcs, n_arcs, n_arcs, n_words + 1, n_ids):
            parts.append(whole[at : at + n])
            at += n
        first, self.final, label, self.target, self.addend, self.start, self.ids = parts
        self.arcs = np.repeat(np.arange(n_states) << 8, np.diff(first)) | label  # in order, as every state's labels are

    def find(self, raw: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit integers, or None: ``raw`` has the words' bytes, and all words walk together."""
        sizes = np.diff(starts, append=len(raw))
        on, state, rank, found = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [None] * len(starts)
        for depth in range(int(sizes.max(initial=0)) + 1):
            ended = sizes[on] == depth
            for k, r in zip(on[ended & (self.final[state] == 1)].tolist(), rank[ended & (self.final[state] == 1)].tolist(), strict=True):
                found[k] = self.ids[self.start[r] : self.start[r + 1]].tobytes()
            on, state, rank = on[~ended], state[~ended], rank[~ended]
            if not len(on) or not len(self.arcs):
                break
            key = (state << 8) | raw[starts[on] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            same = self.arcs[arc] == key
            on, arc, rank = on[same], arc[same], rank[same]
            state, rank = self.target[arc].astype(np.int64), rank + self.addend[arc]
        return found
