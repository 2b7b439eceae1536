"""Fuzzy joins by filter and verification: words by matching letters, texts by trigrams.

Words: pairs go through bounds that cost a few operations each, on whole blocks: lengths, letters that one word has and the other has not,
counts of letters, longest common subsequence (letters as bits of one number). What may still reach the threshold is verified
for many pairs at once. Blocks have words of one length, so only blocks whose lengths allow the threshold meet.

Texts: sets of trigrams, rare ones first. Two sets of the asked similarity share a gram among the first few of both (their prefixes), so frequent
grams join nothing; sizes and places of the shared gram bound the similarity before the sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs

LONG = 63  # longer words are compared one by one
CLASSES = 40  # letters and digits, others shared among these: bounds only get wider


def matrix(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, and their lengths."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.full((len(words), max(int(length.max(initial=0)), 1)), pad, dtype=np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(words)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out, length


def _ratios(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """2 * matching letters / all letters; matching are those of the longest common block (the first in a, then in b), and so on left and right of it."""
    n = len(a)
    matched = np.zeros(n, dtype=np.int64)
    who, zero = np.arange(n), np.zeros(n, dtype=np.int64)
    a_from, a_to, b_from, b_to = zero, la, zero, lb
    places = np.arange(b.shape[1])
    while len(who):
        inside = (places >= b_from[:, None]) & (places < b_to[:, None])
        before = np.zeros((len(who), b.shape[1] + 1), dtype=np.int8)
        best, at_a, at_b = (np.zeros(len(who), dtype=np.int64) for _ in range(3))
        left, right = a[who], b[who]
        for i in range(int(a_to.max())):
            equal = (left[:, i, None] == right) & inside & ((a_from <= i) & (i < a_to))[:, None]
            run = np.where(equal, before[:, :-1] + np.int8(1), np.int8(0))
            before[:, 1:] = run
            end = run.argmax(1)
            size = run[np.arange(len(who)), end].astype(np.int64)
            more = size > best
            best[more], at_a[more], at_b[more] = size[more], i - size[more] + 1, end[more] - size[more] + 1
        matched += np.bincount(who, weights=best, minlength=n).astype(np.int64)
        sides = [(a_from, at_a, b_from, at_b), (at_a + best, a_to, at_b + best, b_to)]
        open_ = [(best > 0) & (s[0] < s[1]) & (s[2] < s[3]) for s in sides]
        who = np.concatenate([who[o] for o in open_])
        a_from, a_to, b_from, b_to = (np.concatenate([s[i][o] for s, o in zip(sides, open_)]) for i in range(4))
    return 2.0 * matched / (la + lb)


def ratios(a: list[str], b: list[str], part: int = 20_000) -> np.ndarray:
    """The matcher's ratio of each pair of words, many pairs at once."""
    out = np.empty(len(a))
    size = np.maximum(np.fromiter(map(len, a), dtype=np.int64, count=len(a)), np.fromiter(map(len, b), dtype=np.int64, count=len(b)))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    order = np.argsort(size, kind="stable")  # pairs of like lengths together
    order = order[size[order] <= LONG]
    for i in range(0, len(order), part):
        at = order[i : i + part]
        (x, nx), (y, ny) = matrix([a[k] for k in at], 0x110001), matrix([b[k] for k in at], 0x110002)
        out[at] = _ratios(x, nx, y, ny) if len(at) else 0.0
    return out


class Words:
    """Words with what the bounds need: lengths, letters as bits, counts of letters, places of letters as bits."""

    def __init__(self, words: list[str]):
        self.words = words
        points, self.length = matrix(words, 0)
        every = np.where(np.arange(points.shape[1]) < self.length[:, None], points % CLASSES, CLASSES).astype(np.int64)
        row = np.repeat(np.arange(len(words)), every.shape[1])
        self.counts = np.bincount(row * (CLASSES + 1) + every.ravel(), minlength=len(words) * (CLASSES + 1)).reshape(len(words), -1)[:, :CLASSES].astype(np.uint16)
        self.letters = every[:, :LONG]
        self.mask = ((self.counts > 0).astype(np.uint64) << np.arange(CLASSES, dtype=np.uint64)).sum(1, dtype=np.uint64)
        self.places = np.zeros((len(words), CLASSES + 1), dtype=np.uint64)
        for i in range(min(points.shape[1], LONG)):
            self.places[np.arange(len(words)), self.letters[:, i]] |= np.uint64(1 << i)
        self.places[:, CLASSES] = 0


def common_subsequence(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of words, or more (letters of one class count as equal)."""
    v = np.full(len(i), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for k in range(b.letters.shape[1]):
            u = v & a.places[i, b.letters[j, k]]
            v = (v + u) | (v - u)
    return np.bitwise_count(~v & ((np.uint64(1) << a.length[i].astype(np.uint64)) - np.uint64(1)))


def close_words(a: Words, b: Words, least: float, part: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, ratio) of the pairs with a ratio of ``least`` or more, and how many pairs had to be verified."""
    found, verified = [], 0
    for at in range(0, len(a.words), step := max(1, part // max(len(b.words), 1))):
        own = slice(at, at + step)
        la, lb = a.length[own, None], b.length[None, :]
        need = least * (la + lb) / 2 - 1e-9  # so many letters have to match
        alone_a, alone_b = np.bitwise_count(a.mask[own, None] & ~b.mask), np.bitwise_count(b.mask & ~a.mask[own, None])
        i, j = np.nonzero((la - alone_a >= need) & (lb - alone_b >= need) & ((a.mask[own, None] & b.mask) > 0))
        need = need[i, j]
        i += at
        large = np.maximum(a.length[i], b.length[j]) > LONG
        good = large | (np.minimum(a.counts[i], b.counts[j]).sum(1, dtype=np.int64) >= need)
        i, j, need, large = i[good], j[good], need[good], large[good]
        good = large.copy()
        good[~large] = common_subsequence(a, i[~large], b, j[~large]) >= need[~large]
        i, j = i[good], j[good]
        r = ratios([a.words[x] for x in i.tolist()], [b.words[x] for x in j.tolist()])
        verified += len(i)
        found.append((i[r >= least], j[r >= least], r[r >= least]))
    return *(np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in range(3)), verified


def _blocks(words: DataFrame, word: str, per_block: int) -> DataFrame:
    """(n, block, words): words of one length in blocks of about ``per_block``."""
    rows = words.select(F.col(word).alias("w"), F.length(word).alias("n"))
    sizes = rows.groupBy("n").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))  # one row a length
    return rows.join(F.broadcast(sizes), "n").groupBy("n", F.pmod(F.xxhash64("w"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("w").alias("words"))


def close_pairs(left: DataFrame, right: DataFrame, least: float, a: str = "qw", b: str = "ew", per_block: int = 1024) -> DataFrame:
    """(a, b, s): distinct words of ``left`` and ``right`` with a matcher's ratio of ``least`` or more (above 0)."""
    theirs = _blocks(right, b, per_block)
    lengths = theirs.agg(F.collect_set("n").alias("lengths"))  # one row: lengths of words
    fits = F.filter("lengths", lambda m: 2 * F.least(m, F.col("n")) >= least * (m + F.col("n")) - 1e-9)
    own = _blocks(left, a, per_block).join(F.broadcast(lengths), F.lit(True)).withColumn("m", F.explode(fits))
    met = own.select("n", "block", F.col("words").alias("a"), "m").join(theirs.select(F.col("n").alias("m"), F.col("block").alias("other"), F.col("words").alias("b")), "m")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = Words(x.as_py()), Words(y.as_py())
                i, j, s, _ = close_words(x, y, max(least, 1e-9))
                yield pa.RecordBatch.from_arrays([pa.array([x.words[k] for k in i.tolist()], pa.string()), pa.array([y.words[k] for k in j.tolist()], pa.string()), pa.array(s, pa.float64())], names=[a, b, "s"])

    return met.repartition("n", "block", "m", "other").select("a", "b").mapInArrow(verify, f"{a} string, {b} string, s double")


def scored_pairs(pairs: DataFrame, a: str = "qw", b: str = "ew") -> DataFrame:
    """(a, b, s): the matcher's ratio of each of the given pairs of words."""

    def verify(batches):
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([x, y, pa.array(ratios(x.to_pylist(), y.to_pylist()), pa.float64())], names=[a, b, "s"])

    return pairs.select(a, b).mapInArrow(verify, f"{a} string, {b} string, s double")


def _grams(texts: DataFrame, text: str) -> DataFrame:
    """(text, g): a row for each trigram of each distinct text. A filter on the grams would go below ``distinct``, to every row; on what is computed it can't."""
    return exprs.computed(texts.select(text).distinct(), gs=exprs.gram_set(F.col(text))).select(text, F.explode("gs").alias("g"))


def _ordered_grams(texts: DataFrame, text: str, frequency: DataFrame) -> DataFrame:
    """(text, grams): a text's distinct trigrams, rare ones first."""
    rows = _grams(texts, text).join(frequency, "g", "left")
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")))
    return rows.groupBy(text).agg(F.transform(ordered, lambda x: x["g"]).alias("grams"))


def gram_candidates(queries: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(query, value, gq, gv) of pairs whose trigram sets may have a Jaccard similarity of ``least``, each once.

    A set of n grams can only reach it with one that shares at least ceil(least * n) of them, hence one of the first n - ceil(least * n) + 1.
    """
    frequency = _grams(values, "value").groupBy("g").agg(F.count("*").alias("df"))

    def keyed(df, text, n, grams, place):
        rows = _ordered_grams(df, text, frequency).withColumn(n, F.size("grams"))
        head = F.slice("grams", 1, (F.col(n) - F.ceil(F.col(n) * float(least) - 1e-9) + 1).cast("int"))
        return rows.select(text, n, F.col("grams").alias(grams), head.alias(f"h{grams}"), F.posexplode(head).alias(place, "g"))

    met = keyed(queries, "query", "nq", "gq", "iq").join(keyed(values, "value", "nv", "gv", "iv"), "g")
    met = met.where((F.col("nq") >= least * F.col("nv") - 1e-9) & (F.col("nv") >= least * F.col("nq") - 1e-9))
    most = 1 + F.least(F.col("nq") - 1 - F.col("iq"), F.col("nv") - 1 - F.col("iv"))  # can be shared from this gram on
    met = met.where(most >= least / (1 + least) * (F.col("nq") + F.col("nv")) - 1e-9)
    return met.where(F.get(F.array_intersect("hgq", "hgv"), F.lit(0)) == F.col("g")).select("query", "value", "gq", "gv")


def gram_pairs(queries: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(query, value, score): distinct texts with a trigram similarity of ``least`` or more."""
    common = F.size(F.array_intersect("gq", "gv"))
    rows = exprs.computed(gram_candidates(queries, values, least), c=common)
    return rows.withColumn("score", F.col("c") / (F.size("gq") + F.size("gv") - F.col("c"))).where(F.col("score") >= least).select("query", "value", "score")
