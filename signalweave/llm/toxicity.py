"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in its words and their beginnings (hashed); a document's is the noisy-or of its
sentences. Only documents have labels; the gradient of the noisy-or shares each document's error out to its
sentences, so the model finds out which words offend. It then tells where: spans of sentences of 0.5 or more.

Cases: a null or empty text has no sentence and gets score 0. Without labels of both classes the score is the
share of toxic labels (0 without any). Repeated rows get equal scores; ties between sentences go to the earlier. An empty table gives no rows.
Texts of any length count whole: batches are cut by characters, and one long text is a batch alone. Kept columns may have any
name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import letters, lowered, pack, run_hashes, runs
from .common import labelled_sample, map_texts, slices

BITS = 18
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("offending", SPANS)])
#: A word counts with its first letters, so many of them, too: insults inflect.
BEGINNINGS = (4, 5, 6, 7)
ENDS = np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)


def sentences(texts: list[str]):
    """(word numbers, sentence of each word, text of each sentence, start and end of each sentence in its text)."""
    points, owner = pack(texts, "\n")
    stop = np.isin(points, ENDS)
    value = np.where(letters()[points], lowered()[points], 0)
    starts, ends = runs(value != 0)
    hashed = [run_hashes(value, starts, ends)]
    of_run = [np.arange(len(starts))]
    place = np.arange(len(value)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(value)]))))
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        hashed.append(run_hashes(np.where(place < n, value, 0), starts, ends)[longer] ^ np.uint64(n << 50))
        of_run.append(longer)
    after = np.cumsum(stop) - stop  # number of stops before each place: a sentence includes its own
    used, sentence = np.unique(after[starts], return_inverse=True)
    marks = np.flatnonzero(stop)
    begin = np.where(used > 0, marks[np.maximum(used - 1, 0)] + 1, 0)
    text = owner[starts[np.searchsorted(sentence, np.arange(len(used)))]] if len(used) else np.empty(0, np.int64)
    first = np.searchsorted(owner, np.arange(len(texts)))
    of_run = np.concatenate(of_run)
    order = np.argsort(of_run, kind="stable")
    hashes = (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int64)[order]
    sentence = sentence[of_run[order]]
    return hashes, sentence, text, begin - first[text], marks[used] + 1 - first[text]


def distinct(words: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once a sentence."""
    pair = np.unique(sentence << BITS | words)
    return pair & ((1 << BITS) - 1), pair >> BITS


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of words
    bias: float
    leak: float = 0.0
    constant: float | None = None

    def score(self, texts: list[str]) -> list:
        n = len(texts)
        if self.constant is not None:
            return [np.full(n, self.constant), [0] * n, [[] for _ in texts]]
        words, sentence, text, begin, end = sentences(texts)
        words, sentence = distinct(words, sentence)
        z = np.bincount(sentence, self.weights[words], minlength=len(text)) + self.bias
        log_none = -np.logaddexp(0, z)
        total = np.where(np.bincount(text, minlength=n) > 0, 1 - (1 - self.leak) * np.exp(np.bincount(text, log_none, minlength=n)), 0.0)
        spans: list[list] = [[] for _ in texts]
        for k in np.flatnonzero(z >= 0):
            spans[text[k]].append({"start": int(begin[k]), "end": int(end[k]), "score": float(1 / (1 + np.exp(-z[k])))})
        return [np.clip(total, 0, 1), np.bincount(text, minlength=n), spans]


def train(words: np.ndarray, sentence: np.ndarray, doc: np.ndarray, plain: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 200, rate: float = 0.3, bias: float = -4.0) -> tuple[np.ndarray, float, float]:
    """Weights of known words, bias and leak by AdaGrad on the noisy-or likelihood.

    words, sentence: known words and their sentences; doc: of each such sentence; plain: sentences without known words of each
    document; y, weight: of each document; start: first weights. The leak is a chance of the label that no sentence
    explains, since labels err. The bias never rises: a sentence without known words is not toxic.
    """
    theta, square, square_b, square_l = start.copy(), np.full(len(start), 1e-8), 1e-8, 1e-8
    leak, total = -3.0, weight.sum()
    for _ in range(rounds):
        z = np.bincount(sentence, theta[words], minlength=len(doc)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p_plain, rho = 1 / (1 + np.exp(-bias)), 1 / (1 + np.exp(-leak))
        none = (1 - rho) * np.exp(np.bincount(doc, -np.logaddexp(0, z), minlength=len(y)) - plain * np.logaddexp(0, bias))
        # d log-likelihood / dz: -p for a clean document's sentence, p * P(none) / P(any) for a toxic one's; the leak likewise
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-12), -1.0) * weight / total
        g = p * pull[doc]
        grad = np.bincount(words, g[sentence], minlength=len(theta)) - 1e-3 * theta / len(y)
        square += grad * grad
        theta += rate * grad / np.sqrt(square)
        g_bias, g_leak = g.sum() + (p_plain * pull * plain).sum(), (rho * pull).sum()
        square_b, square_l = square_b + g_bias**2, square_l + g_leak**2
        leak += rate * g_leak / np.sqrt(square_l)
        bias = min(bias + rate * g_bias / np.sqrt(square_b), -4.0)
    return theta, bias, 1 / (1 + np.exp(-leak))


def per_document(texts: list[str]):
    """(words, sentence of each word) of each text, each word once a sentence; sentences count from 0 in each text."""
    words, sentence, text, _, _ = sentences(texts)
    words, sentence = distinct(words, sentence)
    first = np.searchsorted(text, np.arange(len(texts)))
    cut = np.searchsorted(text[sentence], np.arange(len(texts) + 1)) if len(sentence) else np.zeros(len(texts) + 1, int)
    n = np.bincount(text, minlength=len(texts))
    return [(words[cut[i] : cut[i + 1]], sentence[cut[i] : cut[i + 1]] - first[i], int(n[i])) for i in range(len(texts))]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", per_class: int = 5000, significance: float = 4.5, most_words: int = 20_000) -> ToxicityModel:
    """Learns from the documents of about ``per_class`` of either label, weighted back to the labels' shares.

    The likelihood has many optima, and labels err. So only words get a weight whose number of toxic documents is more than
    ``significance`` standard deviations from what the toxic share makes expected (of these at most the ``most_words``
    furthest), starting at their log-odds. Only where these stand in the sample reaches the driver.
    """
    rows, counts = labelled_sample(docs, labels, label, text, doc_id, per_class, "toxicity")
    constant = ToxicityModel(np.zeros(1), 0.0, constant=1.0 if counts.get(1) and not counts.get(0) else 0.0)
    n_docs = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n_docs) < 2:
        return constant
    rate = n_docs[1] / sum(n_docs.values())

    def frequencies(batches):
        n = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            labels_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for y, (words, _, _) in zip(labels_[a:b], per_document(texts[a:b])):
                    n[y, np.unique(words)] += 1
        on = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(n[0, on]), pa.array(n[1, on])], names=["w", "clean", "toxic"])

    found = rows.select("y", "t").mapInArrow(frequencies, "w int, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = F.col("clean") + F.col("toxic")
    apart = F.abs(F.col("toxic") - n * rate) / F.sqrt(F.greatest(n * rate * (1 - rate), F.lit(0.5)))
    known = found.where(apart > significance).orderBy(F.desc(apart), "w").limit(most_words).toPandas()
    if not len(known):
        return ToxicityModel(np.zeros(1), 0.0, constant=counts[1] / sum(counts.values()))
    numbers = np.full(1 << BITS, -1, dtype=np.int32)
    numbers[known.w] = np.arange(len(known))
    odds = np.log((known.toxic + 0.5) / (known.clean + 0.5)) - np.log(rate / (1 - rate))

    def places(batches):
        for batch in batches:
            labels_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                made = [(numbers[w], s, k) for w, s, k in per_document(texts[a:b])]
                kept = [(w[w >= 0], s[w >= 0], k) for w, s, k in made]
                yield pa.RecordBatch.from_arrays([pa.array(labels_[a:b], pa.int32()), pa.array([x[0] for x in kept], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in kept], pa.list_(pa.int32())), pa.array([x[2] for x in kept], pa.int32())], names=["y", "w", "s", "k"])

    sample = rows.select("y", "t").mapInArrow(places, "y int, w array<int>, s array<int>, k int").toArrow()
    y, k = sample.column("y").to_numpy().astype(float), sample.column("k").to_numpy()
    lengths = np.array(pc.list_value_length(sample.column("w")))
    flat = lambda c: sample.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(y)), lengths)
    _, first, sentence = np.unique(of << 32 | flat("s"), return_index=True, return_inverse=True)
    doc = of[first]
    weight = np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1))
    theta, bias, leak = train(flat("w"), sentence, doc, k - np.bincount(doc, minlength=len(y)), y, weight, np.clip(np.asarray(odds), -3, 3))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[known.w] = theta
    return ToxicityModel(weights, bias, leak)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with score, n_sentences, and the spans (code points) and scores of offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    return map_texts(docs, text, OUT, lambda texts: shared.value.score(texts), docs.columns if keep is None else keep)
