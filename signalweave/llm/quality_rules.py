"""Quality rules by distribution divergence.

For each language the whole corpus gives two references: the shares of character classes, and the shares of
the language's most common words with one more bin for all others. A document is as far from good
text as its Jensen-Shannon distance to the nearest language's references. The rules only judge
documents with enough characters and words for such a distance to mean something; the limit widens for short ones.

Cases: a null text counts as empty and fails the base rules, as any text under ten words does. With no reference
(an empty corpus) nothing is judged. Ties between words go to the smaller. Repeated rows get equal results, an empty table no rows.
Texts of any length count whole: batches are cut by characters, and one long text is a batch alone. Kept columns may have any
name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import TOP, pack
from .common import WORD, checkpointed, count_words, map_texts, quoted, slices

#: Character classes, in the order of their numbers.
CLASSES = ["lower", "upper", "other_letter", "digit", "space", "stop", "symbol", "bracket", "other"]
WORDS = re.compile(WORD)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = T.StructType([T.StructField(x, T.LongType()) for x in BASE] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType())])


@cache
def class_of() -> np.ndarray:
    out = np.full(TOP, CLASSES.index("other"), dtype=np.int64)
    for i in range(TOP):
        c, kind = chr(i), unicodedata.category(chr(i))
        if kind in ("Ll", "Lu"):
            out[i] = CLASSES.index("lower" if kind == "Ll" else "upper")
        elif kind[0] in "LM":
            out[i] = CLASSES.index("other_letter")
        elif kind[0] == "N":
            out[i] = CLASSES.index("digit")
        elif c in " \t\n\v\f\r":
            out[i] = CLASSES.index("space")
        elif c in ".,;:!?'\"-":
            out[i] = CLASSES.index("stop")
        elif c in "#*$%&|<>":
            out[i] = CLASSES.index("symbol")
        elif c in "()[]{}":
            out[i] = CLASSES.index("bracket")
    return out


def class_counts(texts: list[str]) -> np.ndarray:
    points, owner = pack(texts)
    k = len(CLASSES)
    out = np.bincount(owner * k + class_of()[points], minlength=len(texts) * k).reshape(len(texts), k)
    out[:, CLASSES.index("space")] -= 1  # the gap after each text
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


@dataclass
class Rules:
    """References by language, and limits. A limit holds for long texts; ``slack`` / sqrt(n) is added to it.

    A text with none of a language's common words is about 0.42 from it, over the limit from about 80 words on.
    """

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, tuple[list[bytes], np.ndarray]] = field(default_factory=dict)
    class_limit: float = 0.2
    class_slack: float = 2.5
    word_limit: float = 0.2
    word_slack: float = 1.9
    least_chars: int = 200
    least_words: int = 30

    def judge(self, texts: list[str], word_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances from the nearest references (null under the least sizes), and whether either is over its limit."""
        hist = class_counts(texts)
        n_chars, n_words = hist.sum(1), np.array([len(w) for w in word_lists])
        share = hist / np.maximum(n_chars, 1)[:, None]
        by_class = np.min([distance(share, q) for q in self.classes.values()], axis=0) if self.classes else np.full(len(texts), np.nan)
        by_word = np.full(len(texts), np.nan)
        for i, words in enumerate(word_lists):
            if len(words) >= self.least_words and self.words:
                seen = Counter(words)
                best = 1.0
                for common, q in self.words.values():
                    p = np.array([seen.get(w, 0) for w in common] + [0.0])
                    p[-1] = len(words) - p.sum()
                    best = min(best, float(distance(p / len(words), q)))
                by_word[i] = best
        by_class[n_chars < self.least_chars] = np.nan
        failed = (by_class > self.class_limit + self.class_slack / np.sqrt(np.maximum(n_chars, 1))) | (by_word > self.word_limit + self.word_slack / np.sqrt(np.maximum(n_words, 1)))
        return by_class, by_word, failed


def repeated(words: list, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*[words[i:] for i in range(width)]))
    distinct = len(set(windows))
    if distinct == len(windows):
        return 0
    seen = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(i, upto)
            upto = i + width
    return total


def measure(texts: list[str], rules: Rules) -> list:
    """The columns of OUT for these texts."""
    out: list[list] = [[] for _ in BASE]
    lists = []
    for t in texts:
        words = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        lists.append(t.encode().lower().split())
        for column, x in zip(out, (len(words), sum(map(len, words)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated(words))):
            column.append(x)
    n, again = np.array(out[0]), np.array(out[4])
    base_failed = (n < 10) | (100 * again > 20 * n)
    by_class, by_word, failed = rules.judge(texts, lists)
    none = lambda x: [None if v != v else float(v) for v in x]
    return [*out, base_failed, ~base_failed & ~failed, none(by_class), none(by_word)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 60, whole: int = 2000) -> Rules:
    """References from every document, by language (null: one of its own): character classes and the ``top`` words.

    A document's classes weigh in with its characters, but at most like ``whole`` of them, so that a few very long ones don't
    stand for a language: a weight, by which all of every text counts.
    """
    source = docs.select(F.coalesce(F.col(quoted(lang)), F.lit("")).alias("lang"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))

    def classes(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                x = class_counts(texts[a:b]).astype(float)
                x /= np.maximum(x.sum(1, keepdims=True) / whole, 1)
                for g in set(labels[a:b]):
                    sums[g] = sums.get(g, 0) + x[[k == g for k in labels[a:b]]].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "h"])

    rules = Rules()
    bins = [F.sum(F.get("h", F.lit(k))).alias(f"h{k}") for k in range(len(CLASSES))]
    for r in source.mapInArrow(classes, "lang string, h array<double>").groupBy("lang").agg(*bins).collect():
        h = np.array(r[1:], dtype=float)
        if h.sum() > 0:
            rules.classes[r.lang] = h / h.sum()
    counts = checkpointed(count_words(source, "text", group="lang"))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # Ranking needs few rows of a language: a histogram of its words' numbers tells how frequent one has to be.
    step = F.floor(F.log2("n") * 8).cast("int")
    floors: dict[str, int] = {}
    reached: dict[str, int] = {}
    for r in sorted(counts.groupBy("lang", step.alias("s")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.s):
        if reached.get(r.lang, 0) < top:
            floors[r.lang], reached[r.lang] = r.s, reached.get(r.lang, 0) + r.words
    often = counts.where(step >= F.coalesce(*[F.when(F.col("lang") == g, F.lit(x)) for g, x in floors.items()], F.lit(0)))
    ranked = often.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top)
    found: dict[str, list] = {}
    for r in ranked.collect():
        found.setdefault(r.lang, []).append((r.r, bytes(r.word), r.n))
    for g, rows in found.items():
        rows.sort()
        q = np.array([n for _, _, n in rows] + [0.0]) / totals[g]
        q[-1] = 1 - q.sum()
        rules.words[g] = ([w for _, w, _ in rows], q)
    return rules


def apply_rules(docs: DataFrame, rules: Rules, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with the base counts, base_failed, kept and both distances."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)  # a histogram and ``top`` words a language
    return map_texts(docs, text, OUT, lambda texts: measure(texts, shared.value), docs.columns if keep is None else keep)
