"""Topic flows by pairs of countries against plain code over all pairs."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest

from signalweave.operators import pairs

RNG = random.Random(11)
WORDS = ["protests", "protest", "voting", "votes", "bridge", "the", "in", "gas", "strike", "striking", "flood", "floods", "minister", "talks", "war", "is", "x", "port", "grain", "ship"]


def stems(label):
    cut = lambda w: w[:-3] if w.endswith("ing") and len(w) > 5 else w[:-1] if w.endswith("s") and len(w) > 3 else w
    return {cut(w) for w in label.lower().split() if len(cut(w)) > 2}


def terms(label):
    ws = [w for w in re.findall(r"\w+", label.lower()) if len(w) > 1 and w not in pairs.STOP_WORDS]
    return Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])


def cosine(a, b, docs):
    df = Counter(t for d in docs for t in d)
    weigh = lambda c: {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
    x, y = weigh(a), weigh(b)
    size = lambda v: math.sqrt(sum(w * w for w in v.values()))
    return sum(w * y.get(t, 0) for t, w in x.items()) / (size(x) * size(y)) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.1, 0.35, 0.8])
def test_pair_flows_against_all_pairs(spark, threshold):
    start = datetime(2024, 1, 1)
    made = {}
    for i in range(9):
        labels = {" ".join(RNG.choices(WORDS, k=RNG.randint(1, 6))) for _ in range(RNG.randint(1, 7))}
        made[f"C{i}"] = (start + timedelta(hours=RNG.choice([0, 1, 2, 5, 30])), sorted(labels | ({""} if i == 3 else set())))
    rows = [(f"{c}/{x}", c, x, ts) for c, (ts, labels) in made.items() for x in labels] + [("none", "C0", None, made["C0"][0])]
    got = {(r.source, r.target): r for r in pairs.pair_flows(spark.createDataFrame(rows, "topic_id string, country_code string, label string, ts timestamp"), threshold=threshold).collect()}
    want = {}
    for a, (ta, la) in made.items():
        for b, (tb, lb) in made.items():
            hours = (tb - ta).total_seconds() / 3600
            if a == b or (ta, a) > (tb, b) or hours > 24:
                continue
            docs = [terms(x) for x in la + lb] + [Counter()] * ((a == "C0") + (b == "C0"))
            score = lambda x, y: max(cosine(terms(x), terms(y), docs), len(stems(x) & stems(y)) / min(len(stems(x)), len(stems(y))) if stems(x) and stems(y) else 0.0)
            scores = {x: max(score(x, y) for y in lb) for x in la}
            best = max(scores.values())
            if round(best * math.exp(-hours / 6), 6) >= threshold:
                want[a, b] = (best, ",".join(sorted(x for x, s in scores.items() if s >= threshold)[:3]))
    assert want and got.keys() == want.keys()
    for k, (best, topics) in want.items():
        assert abs(got[k].similarity - best) < 2e-6 and got[k].topics == topics


def test_no_topics(spark):
    none = spark.createDataFrame([], "topic_id string, country_code string, label string, ts timestamp")
    assert pairs.pair_flows(none).count() == 0
