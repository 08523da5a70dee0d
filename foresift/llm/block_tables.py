"""Edit costs towards a regular pattern of roles, as tables over whole blocks of messages (the method of the Four Russians).

The wanted roles, by initials, are ``(s?(ua)+)?``. What is left to do before a message is a vector of costs, one for each
state of that pattern. Less their minimum there are only a few dozen such vectors, so the step over one symbol, and with it
that over every block of ``BLOCK`` symbols, is a table from vector to vector and a cost. A run of messages of any length
is one such table too, and those of neighbouring runs compose.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that can be made up in each state.
MADE = "uuau"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: Symbols: nothing, a message that must go, messages by initial, the same cut short.
NOTHING, GONE, WHOLE, CUT = 0, 1, 2, 6
INITIALS = "sua"
SYMBOLS, BLOCK = 10, 4
FAR = 1 << 30


def _made_up(costs: list[int]) -> tuple[int, ...]:
    """Costs in each state once messages may be made up before going on."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s, MADE[s]]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: What is left to do after the last message.
END = _made_up([0, FAR, FAR, 0])


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``letter, cost, next state`` of what can be done with a message, in the order of the letters; nothing for a pad."""
    if symbol == NOTHING:
        return [("", 0, state)]
    found = [("D", DELETE, state)]
    if symbol != GONE:
        more, role = (UNFINISHED, symbol - CUT) if symbol >= CUT else (0, symbol - WHOLE)
        if role < 3 and (to := NEXT.get((state, INITIALS[role]))) is not None:
            found.append(("K", KEEP + more, to))
        found.append(("R", REROLE + more, NEXT[state, MADE[state]]))
    return found


def step(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a message from those after it."""
    return _made_up([min(c + after[to] for _, c, to in choices(symbol, s)) for s in range(4)])


@functools.cache
def _vectors() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All cost vectors less their minimum, that of the end first; the next one and the cost, by symbol and vector."""
    found, at = [END], {END: 0}
    steps: dict[tuple[int, int], tuple[int, int]] = {}
    for v in itertools.count():
        if v == len(found):
            break
        for symbol in range(SYMBOLS):
            before = step(symbol, found[v])
            less = tuple(c - min(before) for c in before)
            if less not in at:
                at[less] = len(found)
                found.append(less)
            steps[symbol, v] = at[less], min(before)
    to = np.array([[steps[s, v][0] for v in range(len(found))] for s in range(SYMBOLS)])
    cost = np.array([[steps[s, v][1] for v in range(len(found))] for s in range(SYMBOLS)])
    return found, to, cost


class Tables:
    """The block tables, and what they say of runs of symbols."""

    def __init__(self):
        self.vectors, to, cost = _vectors()
        n = len(self.vectors)
        self.to, self.cost = np.arange(n)[None, :], np.zeros((1, n), np.int64)
        for _ in range(BLOCK):  # one more symbol in front: code = symbol * SYMBOLS^length + code of the rest
            before = to[:, self.to].reshape(-1, n)
            self.cost = (cost[:, self.to] + self.cost[None]).reshape(-1, n)
            self.to = before
        self.traced: dict[tuple[int, int], tuple[list[str], np.ndarray]] = {}
        self.crossed: dict[int, np.ndarray] = {}

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of a run's blocks, the first of them padded in front."""
        padded = np.concatenate([np.zeros(-len(symbols) % BLOCK, np.int64), symbols.astype(np.int64)]).reshape(-1, BLOCK)
        return padded @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def trace(self, code: int, after: int) -> tuple[list[str], np.ndarray]:
        """A block expanded, given the vector after it: for each state before it the least letters of a cheapest way, and the state after it."""
        if (code, after) not in self.traced:
            symbols = [code // SYMBOLS**k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
            costs = [self.vectors[after]]
            for symbol in reversed(symbols):
                costs.insert(0, step(symbol, costs[0]))
            letters, ends = [], []
            for state in range(4):
                said = ""
                for k, symbol in enumerate(symbols):
                    while True:
                        ways = [(a, to) for a, c, to in choices(symbol, state) if c + costs[k + 1][to] == costs[k][state]]
                        to = NEXT[state, MADE[state]]
                        if symbol and INSERT + costs[k][to] == costs[k][state]:
                            ways.append(("I", to))
                        letter, state = min(ways)
                        said += letter
                        if letter != "I":
                            break
                letters.append(said)
                ends.append(state)
            self.traced[code, after] = letters, np.array(ends)
        return self.traced[code, after]

    def summary(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A run as a table: by the vector after it, the vector before it and the cost, and the state after it by the one before it."""
        v = np.arange(len(self.vectors))
        cost, states = np.zeros(len(v), np.int64), np.tile(np.arange(4), (len(v), 1))
        for code in self.blocks(symbols)[::-1].tolist():
            if code not in self.crossed:
                self.crossed[code] = np.stack([self.trace(code, k)[1] for k in range(len(self.vectors))])
            states = np.take_along_axis(states, self.crossed[code][v], axis=1)
            cost += self.cost[code, v]
            v = self.to[code, v]
        return v, cost, states

    def letters(self, symbols: np.ndarray, after: int, state: int) -> str:
        """The least letters of a cheapest way through a run, from a state before it, given the vector after it."""
        codes, afters = self.blocks(symbols).tolist(), []
        for code in reversed(codes):
            afters.append(after)
            after = int(self.to[code, after])
        said = []
        for code, v in zip(codes, reversed(afters), strict=True):
            letters, ends = self.trace(code, v)
            said.append(letters[state])
            state = int(ends[state])
        return "".join(said)
