"""Suggestions against plain code over a whole fixture, and parts of the unified search that one text never shows together."""

import re

import pytest
from pyspark.sql import functions as F

from signalweave.operators import finding
from signalweave.plans import registry
from signalweave.plans.fixture import Tables, oracle
from tests.compare import connect


def text(t):
    return " ".join(re.sub("[^a-z0-9]+", " ", t.lower()).split())


def grams(t):
    return {("  " + w + " ")[i : i + 3] for w in text(t).split() for i in range(len(w) + 1)}


def suggestions(query, values):
    """values: (value, kind, n). The five best that are strong enough; strong countries, else strong pages, alone."""
    q, hits = text(query), []
    for value, kind, n in values:
        v, a, b = text(value), grams(query), grams(value)
        score = len(a & b) / max(len(a | b), 1)
        least = 0.68 if len(q) <= 3 else 0.25 if len(q) >= 8 and " " in q else 0.45
        if q and v and q != v and score >= max(least, 0.25) and not (kind == "person" and n < 10 and score < 0.5):
            hits.append((-score, -n, kind, value))
    top = sorted(hits)[:5]
    strong = [h for h in top if h[2] == "country" and -h[0] >= 0.5] or [h for h in top if h[2] == "page" and -h[0] >= 0.55] or top
    return {(query, v, kind, -n, round(-s, 3)) for s, n, kind, v in strong}


def test_suggestions_against_plain_code(spark, small):
    con = connect(small)
    ask = lambda body: con.execute(oracle(body)).fetchall()
    values = [(v, "person", n) for v, n in ask("SELECT p, count(*) FROM (SELECT unnest(persons) AS p FROM signals) WHERE length(p) >= 3 GROUP BY ALL")]
    values += [(v, "country", 0) for (v,) in ask("SELECT name FROM countries")] + [(v, "page", n) for v, n in ask("SELECT title, CAST(sum(views) AS BIGINT) FROM pageviews GROUP BY ALL")]
    queries = [q for (q,) in ask("SELECT DISTINCT substr(headline, 1, 7) || substr(headline, 9) FROM signals")]
    got = {(r["query"], r.value, r.kind, r.n, round(r.score, 3)) for r in registry.queries()["k37_fuzzy_suggest"](spark, small).collect()}
    want = set().union(*(suggestions(q, values) for q in queries))
    assert {g[:4] for g in got} == {w[:4] for w in want} and all(abs(dict((w[:4], w[4]) for w in want)[g[:4]] - g[4]) < 0.0011 for g in got)


@pytest.mark.parametrize(
    ("asked", "part", "sql"),
    [
        ("Person 1", "person", "SELECT item FROM (SELECT item, sum(n) AS total FROM (SELECT country_code, item, count(*) AS n FROM (SELECT country_code, unnest(persons) AS item FROM signals WHERE contains(lower(array_to_string(persons, ' ')), 'person') OR contains(array_to_string(persons, ' '), '1')) GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL ORDER BY total DESC, item LIMIT 8)"),
        ("nation_1", "country", "SELECT country_code FROM countries WHERE contains(lower(name), 'nation_1') ORDER BY lower(name) = 'nation_1' DESC, name LIMIT 10"),
        ("view", "page", "SELECT title FROM pageviews WHERE contains(lower(title), 'view') GROUP BY title ORDER BY sum(views) DESC, title LIMIT 20"),
        ("Protests in Ukraine", "named_country", None),
        ("Africa", "region", None),
    ],
)
def test_parts_of_the_unified_search(spark, small, asked, part, sql):
    t = Tables(spark, small)
    rows = finding.unified_search(t.signals, t.countries, t.pageviews, asked).where(F.col("part") == part).orderBy("rank").collect()
    if sql:
        want = [x for (x,) in connect(small).execute(oracle(sql)).fetchall()]
        assert want and sorted(r.item for r in rows) == sorted(want)
    else:
        assert [(r.item, r["rank"]) for r in rows] == [({"named_country": "UA", "region": "africa"}[part], 1)]
