"""Many patterns at once: an automaton as flat tables, run over a whole batch of texts.

All texts of a batch lie in one array of code points and are cut into windows of one width; a step moves all windows on by a letter, so a batch
costs as many steps as a window is wide, however many patterns there are. A window starts early by the length of the longest
pattern, and only matches that end in its own part count, so texts of any length are searched whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 0x110000
#: Other forms of letters that count as these when case is ignored.
SAME_LETTER = {0x130: ord("i"), 0x131: ord("i"), 0x17F: ord("s"), 0x212A: ord("k")}
WIDTH = 512


@cache
def folded() -> np.ndarray:
    """The small letter of each code point."""
    out = np.arange(TOP, dtype=np.uint32)
    for i in range(0x1E944):
        if len(x := chr(i).lower()) == 1:
            out[i] = ord(x)
    for i, x in SAME_LETTER.items():
        out[i] = x
    return out


@cache
def word_letters() -> np.ndarray:
    """Which code points are part of words: letters, digits, the underscore."""
    return np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(TOP)), dtype=bool, count=TOP)


class Automaton:
    """Finds patterns in texts, without regard to case; with ``whole_words`` only where both ends are at the edge of a word."""

    def __init__(self, patterns: Sequence[str], whole_words: bool = True):
        self.whole_words, self.patterns = whole_words, list(patterns)
        points = [folded()[np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)] for p in self.patterns]
        self.length = np.array([len(p) for p in points], dtype=np.int64)
        letters = np.unique(np.concatenate(points)) if points else np.empty(0, np.uint32)
        self.letter_class = np.zeros(TOP, dtype=np.uint16)
        self.letter_class[letters] = np.arange(1, len(letters) + 1)
        self.letter_class = self.letter_class[folded()]
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, p in enumerate(points):
            state = 0
            for x in (np.searchsorted(letters, p) + 1).tolist():
                if x not in children[state]:
                    children[state][x] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][x]
            if len(p):
                ends[state].append(i)
        # breadth first: where a state cannot go on, it goes where its longest proper ending in the trie goes
        self.next = np.zeros((len(children), len(letters) + 1), dtype=np.int32)
        shorter = [0] * len(children)
        queue = deque([0])
        while queue:
            s = queue.popleft()
            if s:
                self.next[s] = self.next[shorter[s]]
                ends[s] = ends[s] + ends[shorter[s]]
            for x, child in children[s].items():
                shorter[child] = int(self.next[shorter[s], x]) if s else 0
                self.next[s, x] = child
                queue.append(child)
        self.ends = np.array([x for e in ends for x in e], dtype=np.int64)
        self.first_end = np.append(0, np.cumsum([len(e) for e in ends]))

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, start) of all matches, also those that overlap."""
        none = np.empty(0, np.int64)
        if not len(texts) or not len(self.patterns):
            return none, none, none
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        before = int(self.length.max())
        windows = -(-len(points) // WIDTH)
        classes = np.zeros(before + windows * WIDTH, dtype=np.uint16)
        classes[before : before + len(points)] = self.letter_class[points]
        at = np.arange(windows) * WIDTH  # of each window's first letter in ``classes``, so ``before`` letters early
        state, hits = np.zeros(windows, dtype=np.int32), []
        has = np.diff(self.first_end) > 0
        for i in range(before + WIDTH):
            state = self.next[state, classes[at + i]]
            if i >= before and (found := has[state]).any():
                hits.append((at[found] + i - before, state[found]))
        if not hits:
            return none, none, none
        end, state = (np.concatenate([h[k] for h in hits]).astype(np.int64) for k in (0, 1))
        n = self.first_end[state + 1] - self.first_end[state]
        pattern = self.ends[np.repeat(self.first_end[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        end = np.repeat(end, n)
        start = end - self.length[pattern] + 1
        if self.whole_words:
            word = np.append(word_letters()[points], False)
            edge = word[start] != np.where(start > 0, word[start - 1], False)
            edge &= word[end] != word[end + 1]
            pattern, start = pattern[edge], start[edge]
        text = np.searchsorted(starts, start, side="right") - 1
        return text, pattern, start - starts[text]

    def first(self, texts: Sequence[str]) -> np.ndarray:
        """For each text the smallest number of a pattern that it has, else -1."""
        text, pattern, _ = self.find(texts)
        out = np.full(len(texts), len(self.patterns), dtype=np.int64)
        np.minimum.at(out, text, pattern)
        out[out == len(self.patterns)] = -1
        return out


def listed(table: Sequence[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The words of a table of (value, comma-joined words), in order, and the value of each."""
    pairs = [(w.strip(), value) for value, words in table for w in words.split(",") if w.strip()]
    return [w for w, _ in pairs], [v for _, v in pairs]


def first_listed(text: Column, table: Sequence[tuple[str, str]], whole_words: bool = True) -> Column:
    """The value of the first word, in the order of the table, that a text has; null if it has none."""
    words, values = listed(table)
    automaton = Automaton(words, whole_words)
    found = pa.array([*values, None], pa.string())

    @F.arrow_udf("string")
    def look_up(texts: pa.Array) -> pa.Array:
        at = automaton.first(texts.fill_null("").to_pylist())
        return found.take(pa.array(np.where(at < 0, len(values), at)))

    return look_up(text)


def matches(texts: DataFrame, text: str, words: Sequence[str], whole_words: bool = False, most: int = 100_000) -> DataFrame:
    """The rows of ``texts`` with ``word``, one for each of the words that a text has.

    The words are shipped as an automaton, so they are bounded: beyond ``most`` a join by pieces (``rollups.containing``) is the way.
    """
    if len(words) > most:
        raise ValueError(f"{len(words)} words; join them with rollups.containing")
    words = list(words)
    automaton = Automaton(words, whole_words)
    names = pa.array(words, pa.string())

    @F.arrow_udf("array<string>")
    def every(column: pa.Array) -> pa.Array:
        rows = column.fill_null("").to_pylist()
        at, pattern, _ = automaton.find(rows)
        pairs = np.unique(np.stack([at, pattern]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(len(rows) + 1)), pa.int32()), names.take(pa.array(pairs[1])))

    return texts.withColumn("word", F.explode(every(F.col(text))))
