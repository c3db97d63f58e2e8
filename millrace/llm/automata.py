"""Probabilistic automata inferred from example strings by merging states of their prefix tree."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

#: States of the prefix tree that fewer examples reach say too little to be compared; those of one depth are one state.
LEAST = 10
#: Literal beginnings of examples: from 3 to 12 characters, shared by ``LEAST`` examples and this part of all.
_HEAD = range(12, 2, -1)
_HEAD_SHARE = 0.05
#: Log-probability of a step or end that a state has never seen; the same in every automaton, so that it tells nothing by itself.
_FLOOR = 1e-3
_UNSEEN = math.log(_FLOOR)
#: States that a new one is compared with: the last ones found to differ, and the first.
_RECENT = 32
_FIRST_HEAD = 0xE000

_CLASS = {c: "0" for c in "0123456789"}
_CLASS |= {c: "a" for c in "abcdef"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: "A" for c in "ABCDEF"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}


def classes(text: str) -> str:
    """Letters and digits by class; other characters stand for themselves."""
    return "".join([_CLASS.get(c, c) for c in text])


@dataclass
class Automaton:
    """``steps[state][symbol]`` is (next state, log-probability); ``ends[state]`` the log-probability to end; ``heads`` the literal
    beginnings that are one symbol each."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    heads: list[str]

    def symbols(self, text: str) -> str:
        for place, head in enumerate(self.heads):
            if text.startswith(head):
                return chr(_FIRST_HEAD + place) + classes(text[len(head) :])
        return classes(text)

    def log_likelihood(self, text: str) -> float:
        """Of the whole string. A symbol never seen in a state leaves the state as it is."""
        state, total = 0, 0.0
        for s in self.symbols(text):
            step = self.steps[state].get(s)
            if step is None:
                total += _UNSEEN
            else:
                state = step[0]
                total += step[1]
        return total + self.ends[state]


def common_heads(examples: list[str]) -> list[str]:
    """Literal beginnings that many examples share, longest first. A shorter one counts without the examples of longer ones."""
    least = max(LEAST, _HEAD_SHARE * len(examples))
    heads, rest = [], examples
    for length in _HEAD:
        seen = Counter(x[:length] for x in rest if len(x) > length)
        new = sorted(h for h, n in seen.items() if n >= least)
        heads += new
        rest = [x for x in rest if x[:length] not in new]
    return heads


class _States:
    """The prefix tree of examples, of which states are merged. A merged state is known by its representative."""

    def __init__(self, examples: Counter):
        self.count, self.end, self.depth = [0], [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[Counter] = [Counter()]
        for symbols, n in sorted(examples.items()):
            node = 0
            self.count[0] += n
            for s in symbols:
                child = self.next[node].get(s)
                if child is None:
                    child = self.next[node][s] = len(self.count)
                    self.count.append(0)
                    self.end.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.next.append({})
                    self.taken.append(Counter())
                self.taken[node][s] += n
                node = child
                self.count[node] += n
            self.end[node] += n
        self.own = list(range(len(self.count)))

    def find(self, state: int) -> int:
        while self.own[state] != state:
            self.own[state] = self.own[self.own[state]]
            state = self.own[state]
        return state

    def merge(self, a: int, b: int) -> None:
        """Make two states one, and those that a symbol leads to from both."""
        todo = [(a, b)]
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            self.own[b] = a
            self.count[a] += self.count[b]
            self.end[a] += self.end[b]
            self.taken[a] += self.taken[b]
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def pool(self, least: int) -> None:
        """Make the rare states of each depth one, which keeps how long examples are."""
        pools: dict[int, int] = {}
        for node in [n for n, count in enumerate(self.count) if count < least]:
            self.merge(pools.setdefault(self.depth[node], node), node)

    def compatible(self, a: int, b: int, width: float) -> bool:
        """Whether ends and steps of both states, and of those they lead to, have like frequencies (Hoeffding bounds)."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            na, nb = self.count[a], self.count[b]
            bound = width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.end[a] / na - self.end[b] / nb) > bound:
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                if abs(self.taken[a][s] / na - self.taken[b][s] / nb) > bound:
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge the prefix tree's states wherever their frequencies pass a Hoeffding test at level ``alpha``, found states first; a
    state that fits none of them is a new one. States that too few examples reach are not tested, but joined by depth."""
    heads = common_heads(examples)
    result = Automaton([], [], heads)
    states = _States(Counter(result.symbols(x) for x in examples))
    states.pool(LEAST)
    width = math.sqrt(0.5 * math.log(2 / alpha))
    red = [0]
    while True:
        found = list(dict.fromkeys(states.find(r) for r in red))
        known = set(found)
        blue = {states.find(c) for r in found for c in states.next[r].values()} - known
        red = found
        if not blue:
            break
        # The most frequent first: its tests are the sharpest.
        node = min(blue, key=lambda b: (-states.count[b], b))
        for state in dict.fromkeys([*reversed(red[-_RECENT:]), red[0]]):
            if states.compatible(state, node, width):
                states.merge(state, node)
                break
        else:
            red.append(node)
    place = {node: i for i, node in enumerate(red)}

    def weight(times: int, of: int) -> float:
        """Room is left for a step and an end never seen."""
        return max(_UNSEEN, math.log((1 - 2 * _FLOOR) * times / of)) if times else _UNSEEN

    for node in red:
        n = states.count[node]
        result.steps.append({s: (place[states.find(c)], weight(states.taken[node][s], n)) for s, c in states.next[node].items()})
        result.ends.append(weight(states.end[node], n))
    return result
