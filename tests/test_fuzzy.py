"""Fuzzy joins against plain code, and how much their bounds leave to verify."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.functions import exprs
from signalweave.operators import finding, fuzzy

RNG = random.Random(11)
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"


def word(n=None):
    return "".join(RNG.choices(LETTERS, weights=range(26, 0, -1), k=n or RNG.randrange(3, 12)))


def misspelt(w):
    i = RNG.randrange(len(w))
    return RNG.choice([w[:i] + w[i + 1 :], w[:i] + RNG.choice(LETTERS) + w[i:], w[:i] + RNG.choice(LETTERS) + w[i + 1 :]]) or "x"


def test_ratio_is_the_matchers():
    pairs = [(word(), word()) for _ in range(1500)] + [("".join(RNG.choices("ab", k=RNG.randrange(1, 9))), "".join(RNG.choices("abc", k=RNG.randrange(1, 9)))) for _ in range(1500)]
    pairs += [("x" * 70, "x" * 69 + "y"), ("ab" * 40, "ba" * 40), ("é日本", "日本é"), ("a" * 63, "a" * 62)]
    got = fuzzy.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert np.array_equal(got, [SequenceMatcher(None, a, b).ratio() for a, b in pairs])


@pytest.mark.parametrize("least", [0.25, 0.6, 0.8])
def test_close_words(spark, least):
    left = list(dict.fromkeys(word() for _ in range(150)))
    right = list(dict.fromkeys([misspelt(w) for w in left] + [word() for _ in range(100)] + ["q" * 80, "日本"]))
    want = {(a, b): s for a in left for b in right if (s := SequenceMatcher(None, a, b).ratio()) >= least}
    i, j, s, verified = fuzzy.close_words(fuzzy.Words(left), fuzzy.Words(right), least)
    assert {(left[x], right[y]): z for x, y, z in zip(i, j, s)} == want and verified >= len(want)
    found = fuzzy.close_pairs(spark.createDataFrame([(w,) for w in left], "qw string"), spark.createDataFrame([(w,) for w in right], "ew string"), least, per_block=20)
    assert {(r.qw, r.ew): r.s for r in found.collect()} == want


def test_bounds_leave_few_pairs_to_verify():
    """3000 by 3000 words: of nine million pairs, a few in a thousand are verified."""
    left = list(dict.fromkeys(word(RNG.randrange(6, 12)) for _ in range(3000)))
    right = [misspelt(w) for w in left]
    i, _, s, verified = fuzzy.close_words(fuzzy.Words(left), fuzzy.Words(right), 0.7)
    assert len(i) >= 0.9 * len(left) and s.min() >= 0.7
    assert verified < 0.01 * len(left) * len(right)


@pytest.mark.parametrize("least", [0.0, 0.25, 0.6, 0.9])
def test_dictionary_at_several_thresholds(spark, least):
    queries = [" ".join(word(RNG.randrange(1, 8)) for _ in range(3)) for _ in range(12)]
    entries = [(f"e{i}", " ".join(RNG.choice([misspelt, lambda w: w, lambda w: w + "s"])(w) for w in RNG.choice(queries).split())) for i in range(40)]
    got = {(r.query, r.entry): r.score for r in finding.fuzzy_dictionary(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(entries, "entry string, text string"), least).collect()}

    def plain(q, text):
        ws, qs = ([w for w in x.split() if len(w) > 1] for x in (text, q))
        if not ws or not qs:
            return None
        return sum(float(x in ws) if len(x) < 3 else max(1.0 if x in w or w in x else SequenceMatcher(None, x, w).ratio() for w in ws) for x in qs) / len(qs)

    want = {(q, e): s for q in queries for e, text in entries if (s := plain(q, text)) is not None and round(s, 6) >= least and (least or s)}
    assert {k for k, v in got.items() if v} == set(want)
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def grams(t):
    return {("  " + w + " ")[i : i + 3] for w in t.split() for i in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.25, 0.5, 0.8])
def test_trigram_pairs(spark, least):
    values = [" ".join(word() for _ in range(RNG.randrange(1, 4))) for _ in range(150)]
    queries = [misspelt(v) for v in values[:60]] + ["", "zz"]
    rows = spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(v,) for v in values], "value string")
    sets = {t: grams(exprs_text(t)) for t in [*queries, *values]}
    want = {(q, v): s for q in set(queries) for v in set(values) if (s := len(sets[q] & sets[v]) / max(len(sets[q] | sets[v]), 1)) >= least}
    got = {(r.query, r.value): r.score for r in fuzzy.gram_pairs(*rows, least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def exprs_text(t):
    return " ".join(t.lower().split())


def test_prefixes_leave_few_candidates(spark):
    """All values share frequent words; candidates stay near what is similar at twice the size, while pairs that share a gram grow with the square."""

    def counted(n):
        values = spark.createDataFrame([(f"breaking news report {word(9)} {word(9)}",) for _ in range(n)], "value string")
        queries = values.select(F.expr("substring(value, 2)").alias("query"))
        rows = fuzzy.gram_candidates(queries.cache(), values, 0.8)
        shared = queries.select("query", F.explode(exprs.gram_set(F.col("query"))).alias("g")).join(values.select("value", F.explode(exprs.gram_set(F.col("value"))).alias("g")), "g").select("query", "value").distinct().count()
        return rows.count(), shared

    small, large = counted(100), counted(200)
    assert large[1] == 200 * 200 and large[0] < 0.1 * large[1] and large[0] < 4 * small[0]
