"""Language-model scoring with Brown classes.

P(word | previous word) = P(class | previous class) * P(word | class). The most frequent words start the classes by
exchange clustering: each word in turn moves to the class where the likelihood of the corpus's class
bigrams is highest, until few move. Then every other word of the frequent ones that occurs often enough moves there too, all words at once in
each pass, by the classes that stand before and after it. Words that are left fall into classes by their endings; a
class of that kind keeps mass for words that training lacks. The end of a text is a class of its own.

Counts come from every training text: words, and the classes beside each word, by a shuffle; bigrams of the first words, classes, endings
and ends in tables of a fixed size per task. Texts are split twice in training, to count words and to write them as numbers. Scoring takes frequent words' counts from a broadcast table of a fixed number of words; what is left, rare words
with their numbers per text, is joined with the counts by word, so nothing that grows with the vocabulary is broadcast.

Cases: a null, empty or blank text is its end alone. Without training texts every word is unknown, N and V are 0.
Rows are told apart by their place, so null and repeated ids are no matter; equal texts get equal scores. An empty table gives no rows.
Texts of any length count whole: batches are cut by characters, and one long text is a batch alone. Kept columns may have any
name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, count_words, most_frequent, quoted, slices

ENDINGS = 32  # classes of other words


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n_words: int, n_classes: int, passes: int = 6) -> np.ndarray:
    """Classes of the first ``n_words`` units of a square table of bigram counts; the other units keep a class each.

    They start in turn, by rank. Each pass tries every word in every class; ties keep the lowest class.
    """
    units = len(bigrams)
    n_classes = max(1, min(n_classes, n_words))
    of = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(units - n_words)])
    total = n_classes + units - n_words
    member = np.zeros((units, total))
    member[np.arange(units), of] = 1
    b = bigrams.astype(float)
    right, left = b @ member, member.T @ b  # unit x class after it, class before it x unit
    g = member.T @ right
    for _ in range(passes):
        moved = 0
        for w in range(n_words):
            old = of[w]
            s = b[w, w]
            r, l = right[w].copy(), left[:, w].copy()
            r[old] -= s
            l[old] -= s
            g[old] -= r
            g[:, old] -= l
            g[old, old] -= s
            # wherever the word goes, its neighbours' classes keep their counts with it
            rows, cols = (g.sum(1) + l)[:n_classes], (g.sum(0) + r)[:n_classes]
            k = np.arange(n_classes)
            out_, in_ = xlogx(g[:n_classes] + r) - xlogx(g[:n_classes]), xlogx(g[:, :n_classes].T + l) - xlogx(g[:, :n_classes].T)
            own = xlogx(g[k, k] + r[:n_classes] + l[:n_classes] + s) - xlogx(g[k, k])
            gain = out_.sum(1) - out_[k, k] + in_.sum(1) - in_[k, k] + own
            gain -= xlogx(rows + r.sum() + s) - xlogx(rows) + xlogx(cols + l.sum() + s) - xlogx(cols)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            g[new] += r
            g[:, new] += l
            g[new, new] += s
            if new != old:
                moved += 1
                of[w] = new
                right[:, old] -= b[:, w]
                right[:, new] += b[:, w]
                left[old] -= b[w]
                left[new] += b[w]
        if moved <= n_words // 200:
            break
    return of


def best_classes(g: np.ndarray, left: np.ndarray, right: np.ndarray, old: np.ndarray, n_classes: int) -> np.ndarray:
    """The class among the first ``n_classes`` where each word adds most to the likelihood, all other words staying where they are.

    g: class bigrams with the words in their ``old`` classes. left, right: words x classes before and after them. Ties keep
    the old class, else the lowest. Only classes that do stand beside a word are looked at, so rare words cost little.
    """
    out, k, every = np.empty(len(old), dtype=np.int64), n_classes, np.arange(n_classes)
    rows, cols, diagonal = g.sum(1)[:k], g.sum(0)[:k], g[every, every]

    def added(o: np.ndarray, side: np.ndarray, other: np.ndarray, table: np.ndarray) -> np.ndarray:
        """What the bigrams with the classes on one side add in each class; ``table``: classes on that side x the word's class."""
        i, j = np.nonzero(side)
        v, gain = side[i, j], np.zeros((len(o), k))
        if not len(i):
            return gain
        there = table[j][:, :k].copy()
        own = np.flatnonzero(o[i] < k)
        there[own, o[i[own]]] -= v[own]
        same = np.flatnonzero(j == o[i])
        there[same] -= other[i[same], :k]
        there = np.maximum(there, 0)  # a word beside itself is taken off twice
        more = xlogx(there + v[:, None]) - xlogx(there)
        inside = np.flatnonzero(j < k)
        more[inside, j[inside]] = 0  # bigrams within the class come on their own
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        gain[i[starts]] = np.add.reduceat(more, starts)
        return gain

    for a in range(0, len(old), 1024):
        o, l, r = old[a : a + 1024], left[a : a + 1024].astype(float), right[a : a + 1024].astype(float)
        here, n_right, n_left = o[:, None] == every, r.sum(1, keepdims=True), l.sum(1, keepdims=True)
        gain = added(o, r, l, g.T) + added(o, l, r, g)
        within = np.maximum(diagonal - here * (l[:, :k] + r[:, :k]), 0)
        gain += xlogx(within + l[:, :k] + r[:, :k]) - xlogx(within)
        row, col = np.maximum(rows - here * n_right, 0), np.maximum(cols - here * n_left, 0)
        gain -= xlogx(row + n_right) - xlogx(row) + xlogx(col + n_left) - xlogx(col)
        out[a : a + 1024] = (gain + here * 1e-9).argmax(1)
    return out


def coded(train: DataFrame, text: str, words: dict[bytes, int], most: int = 1_000_000) -> DataFrame:
    """The texts as numbers of words, written once so that no pass splits them again: rows of int32 (``ids`` binary).

    A word among ``words`` has its number n, another one n + its ending's class, the end of a text n + ENDINGS. A row starts with an end and
    holds whole texts.
    """
    n = len(words)
    shared = train.sparkSession.sparkContext.broadcast(words)  # the frequent words

    def run(batches):
        get, end = shared.value.get, np.array([n + ENDINGS], dtype=np.int32)
        held, size = [end], 0

        def out():
            row = np.concatenate(held).tobytes()
            del held[1:]
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["ids"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                split = t.lower().split()
                ids = np.fromiter((get(w, -1) for w in split), dtype=np.int32, count=len(split))
                for i in np.flatnonzero(ids < 0).tolist():
                    ids[i] = n + ending(split[i])
                held += [ids, end]
                size += len(ids) + 1
                if size > most:
                    yield out()
                    size = 0
        if size:
            yield out()

    return checkpointed(train.select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("t")).mapInArrow(run, "ids binary"))


def bigrams(codes: DataFrame, unit_of: np.ndarray) -> np.ndarray:
    """Bigram counts of units, which ``unit_of`` gives for each number of a word."""
    units = int(unit_of.max()) + 1
    shared = codes.sparkSession.sparkContext.broadcast(unit_of)

    def run(batches):
        table = np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                u = shared.value[np.frombuffer(row, dtype=np.int32)]
                table += np.bincount(u[:-1] * units + u[1:], minlength=units * units)
        for row in range(units):
            part = table[row * units : (row + 1) * units]
            on = np.flatnonzero(part)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), row), pa.int32()), pa.array(on, pa.int32()), pa.array(part[on], pa.int64())], names=["a", "b", "n"])

    found = codes.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((units, units))
    table[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return table


def moved(codes: DataFrame, unit_of: np.ndarray, first: int, last: int, g: np.ndarray, n_classes: int, most: int = 2_000_000) -> np.ndarray:
    """The classes of all words after one pass over those from number ``first`` to before ``last``, each moved to its best class by what
    stands beside it.

    A task hands on one row a word for each ``most`` words it has seen: the classes before it, and those after it, which are told apart
    by the number of classes. So a frequent word is as many rows as there are such stretches, whatever it occurs.
    """
    total = len(g)
    shared = codes.sparkSession.sparkContext.broadcast((unit_of, g))  # numbers of the frequent words and a table of classes

    def beside(batches):
        held, size = [], 0

        def out():
            ids, slots = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(ids, kind="stable")
            ids, slots = ids[order], slots[order]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            bounds = np.append(starts, len(ids))
            for i in range(0, len(starts), 50_000):
                edge = bounds[i : i + 50_001]
                part = slots[edge[0] : edge[-1]]
                offsets = ((edge - edge[0]) * 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[edge[:-1]], pa.int32()), pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(part)])], names=["id", "slots"])

        for batch in batches:
            for row in batch.column(0).to_pylist():
                ids = np.frombuffer(row, dtype=np.int32)
                cls = shared.value[0][ids]
                at = np.flatnonzero((ids >= first) & (ids < last))
                if len(at):
                    held.append((np.repeat(ids[at], 2), np.stack([cls[at - 1], total + cls[at + 1]], 1).astype(np.uint16).ravel()))
                    size += len(at)
                if size > most:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    def choose(batches):
        classes, table = shared.value
        place, seen, sums = np.full(last, -1), [], np.zeros((0, 2 * total), dtype=np.float32)
        for batch in batches:
            ids, slots = batch.column(0).to_numpy(), batch.column(1)
            new = np.unique(ids[place[ids] < 0])
            place[new] = np.arange(len(new)) + sum(map(len, seen))
            if len(new):
                seen.append(new)
                if place[new[-1]] >= len(sums):
                    sums = np.concatenate([sums, np.zeros((max(len(sums), len(new)), 2 * total), dtype=np.float32)])
            offsets = np.frombuffer(slots.buffers()[1], dtype=np.int32)[slots.offset : slots.offset + len(slots) + 1]
            flat = np.frombuffer(slots.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint16)
            key, n = np.unique(np.repeat(place[ids], np.diff(offsets) // 2) * 2 * total + flat, return_counts=True)
            sums.ravel()[key] += n
        if seen:
            ids = np.concatenate(seen)
            to = best_classes(table, sums[: len(ids), :total], sums[: len(ids), total:], classes[ids], n_classes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(to, pa.int32())], names=["id", "to"])

    found = codes.mapInArrow(beside, "id int, slots binary").repartition("id").mapInArrow(choose, "id int, to int").toArrow()
    out = unit_of.copy()
    out[found.column("id").to_numpy()] = found.column("to").to_numpy()
    return out


@dataclass
class BrownModel:
    words: dict[bytes, int]  # of the frequent words, by rank
    counts: np.ndarray
    classes: np.ndarray  # of each frequent word
    n_clustered: int  # classes of clustered words; those of endings and the end's follow
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10 for each frequent word
    ending_total: np.ndarray  # log10 of the denominators of the endings' classes
    tokens: int
    distinct: int
    n_docs: int

    def tables(self, texts: list[bytes]):
        """Per text: tokens, known tokens, base and model sums without what depends on rare counts; rare words with their numbers."""
        get, end = self.words.get, self.n_clustered + ENDINGS
        log_counts = np.log10(self.counts + 0.5)
        base_total = np.log10(self.tokens + 0.5 * (self.distinct + 1))
        out, rare = np.zeros((len(texts), 4)), []
        for i, t in enumerate(texts):
            words = t.lower().split()
            ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
            unknown = np.flatnonzero(ids < 0)
            cls = np.full(len(words) + 2, end)
            cls[1:-1] = self.classes[ids] if len(self.classes) else 0
            others = [words[k] for k in unknown]
            cls[unknown + 1] = [self.n_clustered + ending(w) for w in others]
            known = ids[ids >= 0]
            out[i] = (
                len(words) + 1,
                len(known) + (self.n_docs > 0),
                log_counts[known].sum() + np.log10(self.n_docs + 0.5) - (len(words) + 1) * base_total,
                self.transition[cls[:-1], cls[1:]].sum() + self.emission[known].sum() - self.ending_total[cls[unknown + 1] - self.n_clustered].sum(),
            )
            rare.append(Counter(others))
        return out, rare


def fit(train: DataFrame, text: str = "text", n_classes: int = 128, clustered: int = 512, frequent: int = 1 << 18, least: int = 8, passes: int = 2) -> tuple[BrownModel, DataFrame]:
    """A model of the training rows, and their word counts (word, n), which scoring joins with.

    The ``clustered`` most frequent words start the classes; all of the ``frequent`` ones that occur ``least`` times get one.
    """
    counts = checkpointed(count_words(train, text))
    n_docs = train.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = sums.n + n_docs, sums.v + (n_docs > 0)
    top = most_frequent(counts, frequent).toArrow()
    words = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    n = top.column("n").to_numpy().astype(np.int64)
    ranked = list(words)
    m = int((n >= least).sum())
    first = min(clustered, len(ranked))
    m = max(first, m)
    codes = coded(train, text, words)
    other = [ending(w) for w in ranked] + list(range(ENDINGS + 1))  # the end of a text follows the endings
    start = exchange(bigrams(codes, np.array([*range(first), *(first + e for e in other[first:])])), first, n_classes)
    k = int(start[first])
    # the class of each number: clustered words, frequent words that are too rare for a class of their own, endings, the end
    unit_of = np.array([*start[:first], *(k + e for e in other[first:])], dtype=np.int64)
    g = bigrams(codes, unit_of)
    for _ in range(passes if m > first else 0):
        unit_of = moved(codes, unit_of, first, m, g, k)
        g = bigrams(codes, unit_of)
    of = unit_of[:m]
    # Endings' totals cover all words that are not clustered, of which the driver only knows the frequent ones.
    by_ending = counts.groupBy((F.crc32(F.substring("word", -3, 3)) % ENDINGS).cast("int").alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        mass[r.e], kinds[r.e] = r.n, r.v
    for w, c in zip(ranked[:m], n[:m]):
        mass[ending(w)] -= c
        kinds[ending(w)] -= 1
    ending_total = np.log10(mass + 0.5 * (kinds + 1))
    row, follows = g.sum(1, keepdims=True), (g > 0).sum(1, keepdims=True)
    share = (g.sum(0) + 0.5) / (g.sum() + 0.5 * g.shape[1])
    back = np.where(row > 0, follows / np.maximum(follows + row, 1), 1.0)  # Witten-Bell
    transition = np.log10((1 - back) * g / np.maximum(row, 1) + back * share)
    classes = np.array([*of, *(k + ending(w) for w in ranked[m:])], dtype=np.int64)
    of_class = np.bincount(of, n[:m], minlength=k + 1)
    emission = np.concatenate([np.log10(n[:m] / of_class[of]), np.log10(n[m:] + 0.5) - ending_total[classes[m:] - k]])
    return BrownModel(words, n, classes, k, transition, emission, ending_total, tokens, distinct, n_docs), counts


def score(docs: DataFrame, model: BrownModel, counts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score, score and perplexity of each row."""
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    source = docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(quoted(text)), F.lit("")).alias("__t"))
    kept = [T.StructField(f.name, f.dataType) for f in source.schema.fields[1:-1]]
    sums = [("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField("__row", T.LongType()), *kept, T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType()), *[T.StructField(f"h_{c}", kind) for c, kind in sums]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of frequent words

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            for a, b in slices(texts, 1_000_000):
                made, rare = shared.value.tables(texts[a:b])
                rows = batch.column(0).slice(a, b - a)
                # A text's own row has a word that no text has, so it passes through the join in any partition.
                none = [b"\xff%d" % r for r in rows.to_pylist()]
                owner = np.repeat(np.arange(b - a), [1 + len(x) for x in rare])
                later = np.concatenate(([False], owner[1:] == owner[:-1]))
                own = pa.array(owner, mask=later)  # null on rare words' rows, so these carry nothing else
                words = [w for x, ws in zip(none, rare) for w in (x, *ws)]
                tf = [v for ws in rare for v in (0, *ws.values())]
                heads = [pa.array(made[:, i].astype(np.int64 if i < 2 else np.float64)).take(own) for i in range(4)]
                columns = [batch.column(i).slice(a, b - a).take(own) for i in range(1, batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(owner)), *columns, pa.array(words, pa.binary()), pa.array(tf, pa.int64()), *heads], names=schema.names)

    joined = source.mapInArrow(run, schema).join(counts, "word", "left")
    rare = F.col("tf") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    found = joined.groupBy("__row").agg(
        *[F.first(f.name, ignorenulls=True).alias(f.name) for f in kept],
        *[F.sum(f"h_{c}").alias(f"h_{c}") for c, _ in sums],
        F.sum(rare).alias("rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    total = F.col("h_score") + F.col("rare")
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("h_n").alias("n_tokens"),
        (F.col("h_known") + F.col("rare_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("h_base") + F.col("rare")).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("h_n")).alias("perplexity"),
    )
