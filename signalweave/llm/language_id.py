"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. A binary classifier for each bit, linear in the frequencies of
hashed letter n-grams, predicts whether a text's language has that bit. Decoding weights each bit's
loss by how reliable its classifier is for the codeword's language, takes the nearest codeword, and
flags a text whose two nearest are about as near.

Decoding only says which language is nearest. Whether a text is like any is told by the mean log-likelihood of its n-grams, which for
each language, and for all of them mixed in equal parts, has a limit from the training texts, wider for short texts. A text under all
limits is unlike all languages: it is flagged too. A language with under 20 training texts of 100 n-grams takes the lowest limit of the
others; where none has so many, no text is unlike.

Cases: a null or empty text, or one without letters, is ``und`` with score 0. Ties go to the language that
sorts first. A corpus without labelled rows gives ``und`` everywhere. Repeated rows get equal results, an empty table no rows.
Texts of any length count whole: batches are cut by characters, and one long text is a batch alone. Kept columns may have any
name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import letters, lowered, pack
from .common import map_texts, quoted, renamed, restored, slices, uniform

BITS = 13  # of a feature's number
FEATURES = 1 << BITS
SMOOTH = 1e-5  # share of an n-gram that training lacks
STEP = 0.05  # of the histogram of mean log-likelihoods
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("n_letters", T.LongType())])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of one to three letters, word ends included; letters of each text."""
    points, owner = pack(texts)
    # a gap goes before the first text, too, so that a text has the same n-grams wherever it stands
    owner = np.concatenate(([0], owner))
    value = np.concatenate(([0], np.where(letters()[points], lowered()[points], 0))).astype(np.uint64)
    keep = (value != 0) | np.concatenate(([True], value[:-1] != 0))
    value, owner = value[keep], owner[keep]
    n_letters = np.bincount(owner[value != 0], minlength=len(texts))
    codes, owners = [value[value != 0]], [owner[value != 0]]
    with np.errstate(over="ignore"):
        two = value[:-1] * np.uint64(0x1F123BB5) + value[1:] + np.uint64(1 << 40)
        codes.append(two)
        owners.append(np.where(value[:-1] != 0, owner[:-1], owner[1:]))
        three = (two[:-1] * np.uint64(0x2545F491) + value[2:])[value[1:-1] != 0]
        codes.append(three)
        owners.append(owner[1:-1][value[1:-1] != 0])
        code = (np.concatenate(codes) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    where = np.concatenate(owners) * FEATURES + code.astype(np.int64)
    return np.bincount(where, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32), n_letters


def small_slices(texts: list[str]):
    """Slices of at most 64 texts, since each takes a row of FEATURES counts."""
    for a, b in slices(texts):
        for i in range(a, b, 64):
            yield i, min(i + 64, b)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: all splits for up to six languages, else the best of random ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    reliability: np.ndarray  # languages x bits, each row sums to 1
    logs: np.ndarray | None = None  # languages and their mix x features: log shares
    limit: np.ndarray | None = None  # of each of these for the mean log share in long texts
    spread: np.ndarray | None = None  # of the log shares in each

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Margin of each bit, grown with the evidence; letters and n-grams of each text; its mean log share in each language and their mix."""
        out, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts), dtype=np.int64)
        grams, like = np.ones(len(texts)), np.zeros((len(texts), len(self.languages) + 1))
        for a, b in small_slices(texts):
            x, n[a:b] = features(texts[a:b])
            total = np.maximum(x.sum(1, keepdims=True), 1)
            out[a:b] = (x @ self.weights) / total * np.sqrt(np.minimum(total, 400))
            grams[a:b] = total[:, 0]
            if self.logs is not None:
                like[a:b] = (x @ self.logs.T) / total
        return out, n, grams, like

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword."""
        return np.stack([(self.reliability[k] * np.logaddexp(0, -2 * self.code[k] * margins)).sum(1) for k in range(len(self.languages))], axis=1)

    def unlike(self, grams: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Whether a text is under every limit. Its n-grams of three lengths overlap, so a third of them count as draws."""
        if self.limit is None:
            return np.zeros(len(grams), dtype=bool)
        return (like < self.limit - 3 * self.spread * np.sqrt(3 / grams)[:, None]).all(1)

    def judge(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether it is unlike all languages, letters of each text."""
        if not self.languages:
            none = np.zeros(len(texts), dtype=np.int64)
            return ["und"] * len(texts), none.astype(float), none == 0, none
        margins, n, grams, like = self.evidence(texts)
        loss = self.losses(margins) * self.code.shape[1]
        near = np.exp(-(loss - loss.min(1, keepdims=True)))
        score, best = 1 / near.sum(1), loss.argmin(1)
        none = n == 0
        return [("und" if z else self.languages[k]) for k, z in zip(best, none)], np.where(none, 0.0, score), none | self.unlike(grams, like), n

    def predict(self, texts: list[str], unclear: float = 0.6) -> list:
        lang, score, unlike, n = self.judge(texts)
        return [lang, score, unlike | (score < unclear), n]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 4000, whole: int = 500) -> LanguageModel:
    """Learns from labelled rows: about ``per_language`` of each language (all, if fewer), picked by a hash of their ids.

    A text weighs in with its n-grams, but at most like ``whole`` of them: a weight, by which all of a text counts. Rows with a null
    label, text or id teach nothing.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(lang)).alias("g"), F.col(quoted(text)).alias("t")).where("i is not null and g is not null")
    found = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    names = sorted(found)
    if not names:
        return LanguageModel([], codewords(0), np.zeros((FEATURES, 1)), np.zeros((0, 1)))
    share = F.coalesce(*[F.when(F.col("g") == g, F.lit(min(1.0, per_language / n))) for g, n in found.items()])
    sample = rows.where((uniform("i", "language") < share) & F.col("t").isNotNull()).select("g", "t")

    def gram_counts(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in small_slices(texts):
                x, _ = features(texts[a:b])
                x /= np.maximum(x.sum(1, keepdims=True) / whole, 1)
                for g in set(labels[a:b]):
                    sums[g] = sums.get(g, 0) + x[[k == g for k in labels[a:b]]].sum(0, dtype=np.float64)
        for g, x in sums.items():
            on = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(on), pa.string()), pa.array(on, pa.int32()), pa.array(x[on], pa.float64())], names=["g", "f", "n"])

    counts = np.zeros((len(names), FEATURES))
    place = {g: k for k, g in enumerate(names)}
    for r in sample.mapInArrow(gram_counts, "g string, f int, n double").groupBy("g", "f").agg(F.sum("n").alias("n")).collect():
        counts[place[r.g], r.f] = r.n
    prob = counts / np.maximum(counts.sum(1, keepdims=True), 1e-9)
    code = codewords(len(names))
    plus, minus = np.maximum(code, 0), np.maximum(-code, 0)
    weights = np.log((prob.T @ plus) / np.maximum(plus.sum(0), 1) + SMOOTH) - np.log((prob.T @ minus) / np.maximum(minus.sum(0), 1) + SMOOTH)
    each = np.concatenate([prob, prob[counts.sum(1) > 0].mean(0, keepdims=True) if counts.any() else prob[:1]])
    logs = np.log(each + SMOOTH)
    spread = np.sqrt(np.maximum((each * logs**2).sum(1) - (each * logs).sum(1) ** 2, 0))
    model = LanguageModel(names, code, weights.astype(np.float32), np.full(code.shape, 1 / code.shape[1]), logs.astype(np.float32), spread=spread)
    n_bits, n_steps = code.shape[1], int(np.ceil(-np.log(SMOOTH) / STEP)) + 1

    def checked(batches):
        """Texts, right bits, and a histogram of the mean log shares in the own language and the mix, of texts of 100 n-grams or more."""
        sums = np.zeros((len(each), 1 + n_bits + n_steps), dtype=np.int64)
        for batch in batches:
            own = np.array([place[g] for g in batch.column(0).to_pylist()], dtype=np.int64)
            margins, _, grams, like = model.evidence(batch.column(1).to_pylist())
            np.add.at(sums[:, 0], own, 1)
            np.add.at(sums[:, 1 : 1 + n_bits], own, (margins > 0) == (code[own] > 0))
            step = np.clip(-like / STEP, 0, n_steps - 1).astype(np.int64)
            for k in (own, np.full(len(own), len(names))):
                np.add.at(sums, (k[grams >= 100], 1 + n_bits + step[np.arange(len(own)), k][grams >= 100]), 1)
        k, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[k, j], pa.int64())], names=["k", "j", "n"])

    sums = np.zeros((len(each), 1 + n_bits + n_steps))
    for r in sample.mapInArrow(checked, "k int, j int, n long").groupBy("k", "j").agg(F.sum("n").alias("n")).collect():
        sums[r.k, r.j] = r.n
    known = sums[: len(names)]
    taught = known[:, 0] > 0
    rate = (known[:, 1 : 1 + n_bits] + 1) / (known[:, :1] + 2)
    model.reliability[taught] = np.maximum(rate - 0.5, 0.01)[taught]
    model.reliability /= model.reliability.sum(1, keepdims=True)
    # The middle less five times its way to the twentieth part from below, which a few bad texts among the training texts don't move.
    upto = sums[:, 1 + n_bits :].cumsum(1)
    enough = upto[:, -1] >= 20
    if enough.any():
        middle, low = [-(upto < share * upto[:, -1:]).sum(1) * STEP for share in (0.5, 0.95)]
        limit = middle - 5 * np.maximum(middle - low, 2 * STEP)
        model.limit = np.where(enough, limit, limit[enough].min())
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all, by default) with lang_pred, score, ambiguous and n_letters for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and features x bits: no part of it grows with the rows
    return map_texts(docs, text, OUT, lambda texts: shared.value.predict(texts), docs.columns if keep is None else keep)


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.35, few: int = 40) -> DataFrame:
    """The rows, all their columns as they were, that language ID doesn't turn down.

    These are texts with letters that are not unlike all languages and whose best language scores ``least`` or more, or that have
    under ``few`` letters to tell by. A text between two languages scores about a half and stays; one that is like none of them goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = renamed(docs, docs.columns), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep: list[bool] = []
            for a, b in slices(texts):
                lang, score, unlike, n = shared.value.judge(texts[a:b])
                keep += [bool(g != "und" and (k < few or (s >= least and not u))) for g, s, u, k in zip(lang, score, unlike, n)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select(*restored(docs.columns))
