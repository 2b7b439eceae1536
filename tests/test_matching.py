"""The multi-pattern matcher against regular expressions, and the whole table of country words."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.functions import fixed
from signalweave.operators import matching

RNG = random.Random(3)
WORDS, CODES = matching.listed(fixed.COUNTRY_WORDS)


def by_regex(text, words, codes):
    return next((c for w, c in zip(words, codes) if re.search(rf"\b{re.escape(w)}\b", text, re.I)), None)


@pytest.mark.parametrize("case", [str, str.upper, str.lower, str.title])
def test_every_country_word(case):
    """Each word of the table in a sentence, at the start, at the end, glued to other letters, between signs."""
    texts = [case(f"{a}{w}{b}") for w in WORDS for a, b in (("In ", " today"), ("", ":x"), ("(", ")"), ("x", ""), ("", "s"), ("_", ""), ("é", ""), ("5", " "), ("-", "-"))]
    automaton = matching.Automaton(WORDS)
    got = [CODES[i] if i >= 0 else None for i in automaton.first(texts).tolist()]
    assert got == [by_regex(t, WORDS, CODES) for t in texts]


def test_order_decides():
    assert [CODES[i] for i in matching.Automaton(WORDS).first(["Paris talks on Kyiv", "Niger and Nigeria", "Gulf of Aden, Persian Gulf", "Washington, Thai junta", "ＩＤＦ IDF KKabul Kabul Iıran İran"])] == ["UA", "NG", "YE", "US", "IR"]


@pytest.mark.parametrize("whole", [True, False])
def test_random_patterns(whole):
    """Patterns that are parts of each other, texts longer than a window, matches across its edge."""
    patterns = list(dict.fromkeys("".join(RNG.choices("ab é", k=RNG.randrange(1, 6))) for _ in range(60)))
    texts = ["".join(RNG.choices("ab é-B", k=n)) for n in [0, 1, 2, 5, 30, 511, 512, 513, 3000] for _ in range(4)]
    automaton = matching.Automaton(patterns, whole)
    text, pattern, start = automaton.find(texts)
    got = set(zip(text.tolist(), pattern.tolist(), start.tolist()))
    edge = r"\b" if whole else ""
    want = set()
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            regex = re.compile(f"(?={edge}{re.escape(p)}{edge})", re.I)
            want |= {(i, j, m.start()) for m in regex.finditer(t)}
    assert got == want
    assert matching.Automaton([]).first(["a"]).tolist() == [-1] and matching.Automaton(["a"]).first([]).tolist() == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "From Kyiv"), (2, None), (3, ""), (4, "nothing"), (5, "x" * 5000 + " Lima " + "y" * 5000)], "i long, t string")
    assert {r.i: r.c for r in df.select("i", matching.first_listed(F.col("t"), fixed.COUNTRY_WORDS).alias("c")).collect()} == {1: "UA", 2: None, 3: None, 4: None, 5: "PE"}
    found = matching.matches(df, "t", ["kyiv", "th", "in", "lima", "lim"]).select("i", "word").collect()
    assert {(r.i, r.word) for r in found} == {(1, "kyiv"), (4, "th"), (4, "in"), (5, "lima"), (5, "lim")} and len(found) == 5
    assert np.array_equal(matching.folded()[[0x130, ord("É")]], [ord("i"), ord("é")])
