"""Ranked lexical search, term at a time with a limited set of accumulators.

One pass over the documents keeps, of each one with a term, its number of terms and the postings (term, occurrences) of the terms that
items ask for; these postings give the number of documents with each term. Then each task builds the inverted index of a block of
documents and runs the items over it, an item's terms from the rarest on. A document gets an accumulator when a term first finds it; no
more are made once the bounds of the terms that are left (a term's weight times its largest impact in the block) cannot reach the
k-th best score so far, partial scores of this block and whole ones of those before it alike. Accumulators that exist are updated
to the end, so their scores are exact. A task hands on k documents an item.

Items are the stated, small side: they are broadcast as numbers, at most ``item_bytes`` of them at a time, and further ones in passes of
their own over the postings. Documents are read as often as there are passes and never shuffled.

Cases: null and blank texts have no terms, take no part and count in neither N nor L; items without terms give no rows. An item's repeated
terms count each time. Texts of any length count whole. Equal scores rank by the smaller id; rows with a null id take no part in ranks,
but count as documents. Repeated ids are documents of their own. Equal items (id and text) are one; items of one id and several
texts are ranked each for itself. Empty tables give no rows. Other columns are never read, whatever their names are.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_texts, quoted, renamed

#: Letters A-Z become small ones, all other ASCII but digits and letters a blank; bytes of other code points stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
POSTINGS = T.StructType([T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
FOUND = "item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def postings(docs: DataFrame, text: str, doc_id: str, number: dict[bytes, int]) -> DataFrame:
    """Rows (id, n, terms, tfs) of documents that have terms: how many, and which of ``number`` how often."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def rows(texts):
        known, ns, ids, tfs = shared.value, [], [], []
        for t in texts:
            every = terms(t)
            found = Counter(i for i in map(known.get, every) if i is not None)
            ns.append(len(every))
            ids.append(sorted(found))
            tfs.append([found[i] for i in sorted(found)])
        return [ns, ids, tfs]

    return map_texts(renamed(docs, [], id=F.col(quoted(doc_id)), t=F.col(quoted(text))), "t", POSTINGS, rows, ["id"], as_bytes=True).where("n > 0")


class Block:
    """The inverted index of some documents: for each term their places and what they add to a score."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        place = np.repeat(np.arange(len(ids)), np.diff(offsets))
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[place]))
        order = np.argsort(terms, kind="stable")
        self.place, self.impact = place[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.largest = np.zeros(len(weight), dtype=np.int64)
        np.maximum.at(self.largest, terms, impact)

    def search(self, item: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(id, score) of the documents among which are the k best of those with a score of ``floor`` or more; terms come rarest first."""
        left = np.append(np.cumsum((self.largest[item] * times)[::-1])[::-1], 0)  # what terms from here on can add at most
        score, live, grows = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=bool), True
        for i, (t, x) in enumerate(zip(item, times)):
            if grows and (left[i] < floor or left[i] == 0):
                grows = False
                if not live.any():
                    break
            a, b = self.bounds[t], self.bounds[t + 1]
            at, add = self.place[a:b], x * self.impact[a:b]
            if not grows:
                known = live[at]
                at, add = at[known], add[known]
            score[at] += add
            if grows:
                live[at] = True
                found = score[live]
                if len(found) >= k:
                    floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
        at = np.flatnonzero(live & (score >= max(floor, 1)))
        return self.ids[at], score[at]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _parts(items: DataFrame, item_bytes: int):
    """The items (item_id, text) in groups whose texts have at most ``item_bytes`` together, or one longer text alone."""
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.text) > item_bytes:
            yield held
            held, size = [], 0
        held.append((r.item_id, bytes(r.text)))
        size += len(r.text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block: int = 16384, item_bytes: int = 4 << 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents that score highest for each item, if above 0."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    wanted = items.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(item_text)).cast("binary").alias("text")).where("text is not null").distinct()
    kind = wanted.schema["item_id"].dataType
    made = None
    for part in _parts(wanted, item_bytes):
        asked = [Counter(terms(t)) for _, t in part]
        number = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
        rows = checkpointed(postings(docs, text, doc_id, number))
        n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), dtype=np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most the terms of this part
            df[r.t] = r.df
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        plans = []
        for a in asked:
            rarest = sorted(a, key=lambda x: (df[number[x]], number[x]))
            plans.append((np.array([number[x] for x in rarest], dtype=np.int64), np.array([a[x] for x in rarest], dtype=np.int64)))
        shared = sc.broadcast((weight, plans, n_docs, n_terms))

        def best(batches, shared=shared):
            weight, plans, n_docs, n_terms = shared.value
            held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in plans]

            def see(parts):
                table = pa.Table.from_batches(parts).combine_chunks()
                lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
                index = Block(table.column("id").to_numpy(), table.column("n").to_numpy(), np.append(0, np.cumsum(lists[0].value_lengths().to_numpy())), *[x.flatten().to_numpy().astype(np.int64) for x in lists], weight, n_docs, n_terms)
                for i, (item, times) in enumerate(plans):
                    ids, scores = index.search(item, times, k, int(held[i][1][-1]) if len(held[i][1]) == k else 0)
                    if len(ids):
                        held[i] = _best(np.concatenate([held[i][0], ids]), np.concatenate([held[i][1], scores]), k)

            parts: list = []
            for batch in batches:
                parts.append(batch)
                if sum(p.num_rows for p in parts) >= block:
                    see(parts)
                    parts = []
            if any(p.num_rows for p in parts):
                see(parts)
            for i, (ids, scores) in enumerate(held):
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i), pa.int32()), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

        found = rows.where("id is not null and size(terms) > 0").mapInArrow(best, FOUND)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(part)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        ranked = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        made = ranked if made is None else made.unionByName(ranked)
    return made if made is not None else spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
