"""Quality by compression: how much better a text packs with a dictionary of good texts than with one of bad.

Two zstandard dictionaries are built from labelled texts. A text's score comes from its sizes with
either: their difference over their sum, and how far the text packs at all, through a logistic curve that is
fitted on other labelled rows than the dictionaries.

Cases: a null or empty text has difference 0 and ratio 1 and gets the curve's value there. With one class of labels
only, the score is that class's share; with none it is 0.5. Repeated rows get equal scores, an empty table no rows.
Texts of any length count whole: batches are cut by characters, and one long text is a batch alone. Kept columns may have any
name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, map_texts

OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("size_good", T.LongType()), T.StructField("size_bad", T.LongType())])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression with an intercept (the last one), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    curve: np.ndarray  # of the difference, the ratio, and 1
    level: int = 3

    def packers(self) -> list:
        if not hasattr(self, "_packers"):
            made = []
            for d in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(d)
                known.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
            self._packers = made
        return self._packers

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        good, bad = self.packers()
        return np.array([(len(good.compress(t)), len(bad.compress(t))) for t in texts], dtype=np.int64).reshape(-1, 2)

    def inputs(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        length = np.fromiter(map(len, texts), dtype=float, count=len(texts))
        difference = np.where(length > 0, (sizes[:, 1] - sizes[:, 0]) / sizes.sum(1), 0.0)
        return np.column_stack([difference, np.where(length > 0, np.minimum(sizes.min(1) / np.maximum(length, 1), 1.0), 1.0)])

    def score(self, texts: list[bytes]) -> list:
        if not self.good:
            return [np.full(len(texts), 1 / (1 + np.exp(-self.curve[-1]))), [0] * len(texts), [0] * len(texts)]
        sizes = self.sizes(texts)
        z = np.column_stack([self.inputs(texts, sizes), np.ones(len(texts))]) @ self.curve
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))), sizes[:, 0], sizes[:, 1]]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", per_class: int = 3000, most_bytes: int = 12_000_000, dictionary: int = 64_000) -> CompressionModel:
    """Learns from the documents of about ``per_class`` of either label and at most about ``most_bytes`` of their text.

    Every other one, in the order of a hash, builds the dictionaries; the others fit the curve, weighted back to the labels' shares.
    """
    sample, counts = labelled_sample(docs, labels, label, text, doc_id, per_class, "compression")
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    constant = CompressionModel(b"", b"", np.array([0.0, 0.0, np.log(prior / (1 - prior))]))
    rows = sample.select("y", "u", F.encode("t", "UTF-8").alias("t"))
    found = {r.y: r.b for r in rows.groupBy("y").agg(F.sum(F.octet_length("t")).alias("b")).collect()}
    if len(found) < 2:
        return constant
    thin = F.when(F.col("y") == 1, min(1.0, most_bytes / 2 / max(found[1], 1))).otherwise(min(1.0, most_bytes / 2 / max(found[0], 1)))
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for y, _, t in sorted((r.y, r.u, bytes(r.t)) for r in rows.where(F.col("u") < thin).collect()):
        parts[y].append(t)
    if min(map(len, parts.values())) < 2:
        return constant
    model = CompressionModel(_dictionary(parts[1][::2], dictionary), _dictionary(parts[0][::2], dictionary), np.zeros(3))
    texts = parts[0][1::2] + parts[1][1::2]
    y = np.repeat([0.0, 1.0], [len(parts[0][1::2]), len(parts[1][1::2])])
    weight = np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1))
    model.curve = logistic(model.inputs(texts, model.sizes(texts)), y, weight * len(y) / weight.sum())
    return model


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with score (0 to 1) and both packed sizes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    return map_texts(docs, text, OUT, lambda texts: shared.value.score(texts), docs.columns if keep is None else keep, as_bytes=True)
