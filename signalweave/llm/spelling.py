"""Spelling variants: words one edit apart, found in a trie over letter-group counts.

A word becomes a vector: how often each of ``GROUPS`` of letters occurs in it. One inserted, deleted or replaced letter changes at most one
count by +1 and one by -1, so of two near words one reaches the other with a deficit of one and a surplus of one at most. Words
are arranged in a trie by successive counts. Its first ``TOP`` levels are the partitioning: a word is stored under its own counts,
and goes as a visitor to where the budget can lead within these levels (one less in a group, or one less in a group and one more in a later one).
The other levels are searched depth first within a task, all visitors together level by level, each with what is left of its budget;
the words of the leaves that are reached are compared letter by letter. Of two near words just one visits the other: the one whose count is
larger at the first difference, or with equal counts the later word. Groups with over ``most`` words are dealt out in blocks.

Cases: null and empty texts have no words; texts and words of any length count whole. Rows with a null id count, but no letter of
their words is deleted. Repeated rows count each time. An empty table, or one without near words, gives the words alone. Other columns
are never read, whatever their names are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, renamed

#: Letters by groups; the first ones, about an eighth of all letters each, are the top of the trie. Others: two groups by odd and even code points.
GROUPS = ("e", "ai", "ns", "tr", "ol", "d", "u", "c", "m", "p", "h", "g", "bv", "fkwy", "jqxz")
TOP, N_GROUPS = 5, len(GROUPS) + 2
#: A run of the letters A-Z, a-z and U+00C0 to U+00FF, in UTF-8 with A-Z as small letters.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_GROUP = np.array([next((i for i, g in enumerate(GROUPS) if chr(c) in g), len(GROUPS) + c % 2) for c in range(256)], dtype=np.int64)
_FIELD = 12  # bits of a count in a key; counts go in modulo that, which may only add words to compare
SHORT = 40  # longer words are compared one by one
STORED, DEFICIT, BOTH, VISITOR = range(4)  # what a row is, or how much of its budget it has spent


def observed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 7, every: int = 31, most: int = 400_000) -> DataFrame:
    """(word, n): runs of letters in small letters of ``least`` or more; where ``every`` divides the crc32 of id and run, a letter is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            words, ns = list(counts), list(counts.values())
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()).cast(pa.string()), pa.array(ns[i : i + 50_000], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                start = None if i is None else zlib.crc32(f"{i}:".encode())
                for word, n in Counter(RUN.findall(t.lower())).items():
                    if len(word) < least:
                        continue
                    length = len(word) - word.count(b"\xc3")
                    if start is not None and (h := zlib.crc32(word, start)) % every == 0:
                        letters = word.decode()
                        at = h % length
                        word, length = (letters[:at] + letters[at + 1 :]).encode(), length - 1
                    if length >= least:
                        counts[word] += n
                if len(counts) > most:
                    yield from out()
        yield from out()

    rows = renamed(docs, [], id=F.col(quoted(doc_id)).cast("string"), t=F.coalesce(F.col(quoted(text)), F.lit("")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of the letter groups of words in Latin-1."""
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    return np.bincount(row * N_GROUPS + _GROUP[np.frombuffer(b"".join(words), dtype=np.uint8)], minlength=len(words) * N_GROUPS).reshape(len(words), N_GROUPS)


def _fields(counts: np.ndarray) -> np.ndarray:
    """Counts of the top groups as parts of a key."""
    return (counts[:, :TOP] & ((1 << _FIELD) - 1)) << (np.arange(TOP) * _FIELD)


def dealt(words: DataFrame) -> DataFrame:
    """Rows (k, kind, word, n): each word at its own place, and as a visitor wherever it can get to in the top of the trie."""

    def run(batches):
        for batch in batches:
            v = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            own, less, more = _fields(v), _fields(v - 1), _fields(v + 1)
            key, every = own.sum(1), np.arange(len(v))
            made = [(every, key, STORED)]
            for a in range(TOP):
                some = np.flatnonzero(v[:, a] > 0)
                there = key[some] - own[some, a] + less[some, a]
                made.append((some, there, DEFICIT))
                made += [(some, there - own[some, b] + more[some, b], BOTH) for b in range(a + 1, TOP)]
            for at, k, kind in made:
                piece = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(at), kind), pa.int32()), piece.column(0), piece.column(1)], names=["k", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "k long, kind int, word string, n long")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by just one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return start + end >= max(len(a), len(b)) - 1


class Trie:
    """Stored words in the order of their key and counts: a node is a range of rows with equal counts so far."""

    def __init__(self, key: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort([*counts.T[::-1], key])
        key, counts = key[self.order], counts[self.order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        self.keys, self.wide = key[new], int(counts.max(initial=0)) + 2
        self.children = []
        for level in range(counts.shape[1]):
            node = np.cumsum(new) - 1
            new = new | np.concatenate(([True], counts[1:, level] != counts[:-1, level]))
            self.children.append((node * self.wide + counts[:, level])[new])
        self.start = np.append(np.flatnonzero(new), len(key))

    def find(self, key: np.ndarray, counts: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(visitor, row, spent) for the words of all leaves that visitors reach with their budgets."""
        node = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        who = np.flatnonzero(self.keys[node] == key)
        node, spent = node[who], spent[who]
        for level, children in enumerate(self.children):
            steps = []
            for change, of, then in ((0, None, None), (-1, STORED, DEFICIT), (1, DEFICIT, BOTH)):
                at = np.arange(len(who)) if of is None else np.flatnonzero(spent == of)
                count = counts[who[at], level] + change
                child = node[at] * self.wide + count
                there = np.minimum(np.searchsorted(children, child), len(children) - 1)
                good = (children[there] == child) & (count >= 0) & (count < self.wide)
                steps.append((who[at][good], there[good], spent[at][good] if of is None else np.full(good.sum(), then)))
            who, node, spent = (np.concatenate([s[i] for s in steps]) for i in range(3))
        size = self.start[node + 1] - self.start[node]
        first = np.repeat(self.start[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(who, size), self.order[first], np.repeat(spent, size)


def near_rows(key: np.ndarray, kind: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of rows with near words of one key, b a stored one; each unordered pair of words once."""
    counts = vectors(words)[:, TOP:]
    stored = np.flatnonzero(kind == STORED)
    none = np.empty(0, np.int64)
    if not len(stored):
        return none, none
    trie = Trie(key[stored], counts[stored])
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    left, right = np.zeros((2, len(words), SHORT), dtype=np.uint8)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    short = length[row] <= SHORT
    left[row[short], place[short]] = flat[short]
    right[row[short], (length[row] - 1 - place)[short]] = flat[short]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(words), 20_000):
        who, b, spent = trie.find(key[at : at + 20_000], counts[at : at + 20_000], np.where(kind == VISITOR, STORED, kind)[at : at + 20_000])
        a, b = who + at, stored[b]
        ok = (np.abs(length[a] - length[b]) <= 1) & (a != b)
        a, b, spent = a[ok], b[ok], spent[ok]
        for i in range(0, len(a), 100_000):
            x, y, s = a[i : i + 100_000], b[i : i + 100_000], spent[i : i + 100_000]
            plain = (length[x] <= SHORT) & (length[y] <= SHORT)
            lx, ly = left[x], left[y]
            differ, back = lx != ly, right[x] != right[y]
            start = np.where(differ.any(1), differ.argmax(1), SHORT)
            near = differ.any(1) & (start + back.argmax(1) >= np.maximum(length[x], length[y]) - 1)
            # equal counts: the later word visits the earlier, so that each pair counts once
            rows, first = np.arange(len(x)), np.minimum(start, SHORT - 1)
            near &= (s != STORED) | (lx[rows, first] > ly[rows, first])
            near[~plain] = [one_edit(words[p], words[q]) and (t != STORED or words[p] > words[q]) for p, q, t in zip(x[~plain], y[~plain], s[~plain])]
            found.append((x[near], y[near]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def _search(batches: Iterator[pa.RecordBatch], rows: int = 150_000) -> Iterator[pa.RecordBatch]:
    """Rows (word, n_near, near, near_n) of rows (k, b, kind, word, n) sorted by (k, b): for a row's word what it has near in one place."""

    def close(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        key, block, kind, n = (table.column(c).to_numpy() for c in ("k", "b", "kind", "n"))
        both = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
        text = table.column("word").to_pylist()
        a, b = near_rows(both, kind, [w.encode("latin-1") for w in text])
        if not len(a):
            return
        own, near = np.concatenate([a, b]), np.concatenate([b, a])
        some = np.unique(own)
        rank = np.empty(len(text), dtype=np.int64)
        rank[some[np.argsort(np.array([text[i] for i in some], dtype=object))]] = np.arange(len(some))
        order = np.lexsort((rank[near], -n[near], own))
        own, near = own[order], near[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count = np.diff(np.append(first, len(own)))
        words = table.column("word").combine_chunks()
        yield pa.RecordBatch.from_arrays([words.take(pa.array(own[first])), pa.array(count), words.take(pa.array(near[first])), pa.array(n[near[first]])], names=["word", "n_near", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        k, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = 0
        if size > rows:  # up to where the next group starts
            last = held[-1]
            changed = np.flatnonzero((k != last.column(0)[-1].as_py()) | (b != last.column(1)[-1].as_py()))
            if len(changed):
                start = int(changed[0])
                yield from close([*held, batch.slice(0, start)])
                held, size = [], 0
        held.append(batch.slice(start))
        size += batch.num_rows - start
    if size:
        yield from close(held)


def near_words(words: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) that have near ones: how many, and the most frequent, ties by the smaller."""
    rows = dealt(words)
    large = checkpointed(rows.where(F.col("kind") == STORED).groupBy("k").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1"))
    if large.isEmpty():
        rows = rows.withColumn("b", F.lit(0))
    else:  # at most words / most keys
        rows = rows.join(F.broadcast(large), "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("kind", F.when((F.col("kind") == STORED) & (F.col("b") != F.col("own")), VISITOR).otherwise(F.col("kind")))
    found = rows.select("k", "b", "kind", "word", "n").repartition("k", "b").sortWithinPartitions("k", "b").mapInArrow(_search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_n: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words that occur ``least_n`` times: the near word that is ``ratio`` times as frequent, if
    the most frequent one is, and where following forms ends."""
    words = checkpointed(observed(docs, text, doc_id).where(F.col("n") >= least_n))
    rows = words.join(near_words(words), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    known = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    rows = checkpointed(rows.select("word", F.when(known, F.col("near")).alias("form"), "n", "n_near", F.when(known, F.col("near_n")).alias("form_n")))
    # a form is ``ratio`` times as frequent as its word, so chains are short, and each round doubles what has been followed
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = checkpointed(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return rows.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
