"""A minimal acyclic automaton of words with a number for each, as flat arrays that can be memory-mapped."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


class _Node:
    __slots__ = ("final", "edges", "count")

    def __init__(self):
        self.final, self.edges, self.count = False, {}, 0


def build(words: list[bytes]) -> bytes:
    """The automaton of sorted distinct words. Suffixes are shared: a state is kept once for each right language.

    Each edge carries how many words go before it from its state, so the sum along a word's path is its place in the
    sorted list. Layout: number of states and edges, then per edge its key (state * 256 + byte, sorted), target and
    sum, then whether each state is final.
    """
    known: dict[tuple, _Node] = {}
    root = _Node()
    path: list[tuple[_Node, int, _Node]] = []  # of the last word: what may still get edges

    def close(upto: int) -> None:
        while len(path) > upto:
            parent, label, child = path.pop()
            same = known.setdefault((child.final, *((b, id(n)) for b, n in child.edges.items())), child)
            parent.edges[label] = same

    last = b""
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(common)
        node = path[-1][2] if path else root
        for byte in word[common:]:
            child = _Node()
            node.edges[byte] = child
            path.append((node, byte, child))
            node = child
        node.final = True
        last = word
    close(0)

    number: dict[int, int] = {id(root): 0}
    states = [root]
    for node in states:  # grows as states are met
        for child in node.edges.values():
            if id(child) not in number:
                number[id(child)] = len(states)
                states.append(child)
    left: list[_Node] = [root]
    done: set[int] = set()
    while left:  # counts of words below each state, children first
        node = left[-1]
        open_ = [c for c in node.edges.values() if id(c) not in done]
        if open_:
            left.extend(open_)
            continue
        left.pop()
        if id(node) not in done:
            node.count = node.final + sum(c.count for c in node.edges.values())
            done.add(id(node))
    keys, targets, sums = [], [], []
    for i, node in enumerate(states):
        before = int(node.final)
        for byte, child in sorted(node.edges.items()):
            keys.append(i << 8 | byte)
            targets.append(number[id(child)])
            sums.append(before)
            before += child.count
    head = np.array([len(states), len(keys)], dtype=np.int64)
    final = np.fromiter((n.final for n in states), dtype=np.uint8, count=len(states))
    return b"".join(np.asarray(x, dtype=kind).tobytes() for x, kind in ((head, np.int64), (keys, np.int64), (targets, np.int32), (sums, np.int32), (final, np.uint8)))


class Automaton:
    """A built automaton, memory-mapped from a file of this worker's own that has no name any more."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n_states, n_edges = np.frombuffer(self._map, np.int64, 2)
        at = 16
        self.keys = np.frombuffer(self._map, np.int64, n_edges, at)
        self.targets = np.frombuffer(self._map, np.int32, n_edges, at := at + 8 * n_edges)
        self.sums = np.frombuffer(self._map, np.int32, n_edges, at := at + 4 * n_edges)
        self.final = np.frombuffer(self._map, np.uint8, n_states, at + 4 * n_edges)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the sorted list, or -1: all words walk together, a byte at a time."""
        out = np.full(len(words), -1, dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        alive = np.arange(len(words))
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            if ended.any():
                who = alive[ended]
                out[who] = np.where(self.final[state[who]] == 1, total[who], -1)
                alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | data[begin[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[edge] == key
            alive, edge = alive[good], edge[good]
            state[alive] = self.targets[edge]
            total[alive] += self.sums[edge]
            step += 1
        return out
