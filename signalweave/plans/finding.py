"""Queries: search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..operators import finding as S
from ..operators import rollups as R
from .registry import query


def _items(array, words, limit):
    like = " OR ".join(f"contains(lower(array_to_string({array}, ' ')), '{w}')" for w in words)
    return f", m AS (SELECT country_code, unnest({array}) AS item FROM signals WHERE {like}), c AS (SELECT item, country_code, count(*) AS n FROM m WHERE item NOT LIKE 'TAX\\_%' ESCAPE '\\' GROUP BY ALL HAVING count(*) >= 2), tot AS (SELECT item, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL ORDER BY total DESC, item LIMIT {limit}), rk AS (SELECT c.*, total, row_number() OVER (PARTITION BY c.item ORDER BY n DESC, country_code) AS rk FROM c JOIN tot ON c.item = tot.item) SELECT item, total, string_agg(country_code || ':' || n, ',' ORDER BY rk) AS countries FROM rk WHERE rk <= 3 GROUP BY ALL"


@query("k34_search_themes", _items("themes", ["click", "k7"], 10))
def k34(t):
    return S.search_items(t.signals, ["click", "k7"], "themes")


@query("k34_search_persons", _items("persons", ["person 1"], 8))
def k34p(t):
    return S.search_items(t.signals, ["Person 1"], "persons", limit=8, excluded=())


@query("k35_search_countries", ", r AS (SELECT country_code, name, CASE WHEN lower(country_code) = 'nation_1' THEN 1 WHEN lower(name) = 'nation_1' THEN 2 WHEN starts_with(lower(name), 'nation_1') THEN 3 WHEN contains(lower(name), 'nation_1') THEN 4 END AS rank FROM countries) SELECT country_code, name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, name LIMIT 10")
def k35(t):
    return S.search_countries(t.countries, "nation_1")


@query("k36_search_signals", "SELECT signal_id, headline FROM signals WHERE contains(lower(headline), 'nation_11') OR contains(lower(source_name), 'src11') ORDER BY ts DESC, signal_id LIMIT 50")
def k36(t):
    return S.search_signals(t.signals, ["nation_11", "src11"]).select("signal_id", "headline")


@query("k36_search_pages", "SELECT title, CAST(sum(views) AS BIGINT) AS views FROM pageviews WHERE contains(lower(title), 'click') GROUP BY ALL ORDER BY views DESC, title LIMIT 20")
def k36p(t):
    return S.search_pages(t.pageviews, ["click"])


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("c15_trigram_similarity", ", h AS (SELECT DISTINCT headline FROM signals), g AS (SELECT headline, " + GRAMS.format("headline") + " AS a, " + GRAMS.format("'click in chna'") + " AS b FROM h) SELECT headline, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM g")
def c15(t):
    return t.signals.select("headline").distinct().withColumn("score", R.r(exprs.trigram_similarity(F.col("headline"), F.lit("click in chna"))))


@query("k37_fuzzy_candidates", ", q AS (SELECT DISTINCT lower(event_type) || ' in ' || lower(country_code) AS query FROM signals), v AS (SELECT name AS value FROM countries UNION SELECT title FROM pageviews), x AS (SELECT query, value, " + GRAMS.format("query") + " AS a, " + GRAMS.format("value") + " AS b FROM q, v), s AS (SELECT query, value, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM x) SELECT query, value, round(score, 6) AS score FROM s WHERE score >= 0.25")
def k37(t):
    queries = t.signals.select(F.concat_ws(" in ", F.lower("event_type"), F.lower("country_code")).alias("query")).distinct()
    values = t.countries.select(F.col("name").alias("value")).union(t.pageviews.select("title")).distinct().select("value", F.lit("x").alias("kind"), F.lit(0).alias("n"))
    return S.fuzzy_candidates(queries, values).select("query", "value", R.r(F.col("score")).alias("score"))


@query("k37_fuzzy_suggest")
def k37s(t):
    """Suggestions for every headline with a letter missing; tested against plain code."""
    queries = t.signals.select(F.concat(F.substring("headline", 1, 7), F.expr("substring(headline, 9)")).alias("query")).distinct()
    return S.fuzzy_suggest(queries, t.signals, t.countries, t.pageviews)


@query("c5_query_variants", ", h AS (SELECT DISTINCT lower(headline) AS query, replace(lower(headline), '_', ' ') AS q FROM signals) SELECT query, q AS variant FROM h UNION SELECT query, replace(q, ' ', '') FROM h UNION SELECT query, array_to_string(list_transform(string_split(q, ' '), lambda w: CASE WHEN w LIKE '%virus' THEN w WHEN length(w) > 4 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 4 AND w LIKE '%es' THEN substr(w, 1, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END), ' ') FROM h")
def c5(t):
    """Headlines have four words or more, so there are no other orders."""
    return S.query_variants(t.signals.select(F.lower("headline").alias("query")).distinct()).select("query", "variant")


@query("c5_short_queries", ", q AS (SELECT DISTINCT event_type || ' ' || source_family AS query, event_type AS a, source_family AS b FROM signals), v AS (SELECT query, unnest([a || ' ' || b, a || b, CASE WHEN length(a) > 3 AND a LIKE '%s' THEN left(a, -1) ELSE a END || ' ' || CASE WHEN length(b) > 3 AND b LIKE '%s' THEN left(b, -1) ELSE b END, b || ' ' || a]) AS variant FROM q) SELECT DISTINCT query, variant FROM v")
def c5s(t):
    """Two words: itself, joined, singular, the other way round."""
    return S.query_variants(t.signals.select(F.concat_ws(" ", "event_type", "source_family").alias("query")).distinct()).select("query", "variant")


@query("k38_fuzzy_dictionary")
def k38(t):
    """The words of every page's host against the labels of all themes; the operator is tested against plain code."""
    queries = t.raw("pages").select(F.translate(exprs.domain(F.col("url")), ".-", "  ").alias("query")).distinct()
    # a label takes dozens of patterns: one a theme, not one a row
    themes = R.exploded(t.signals).select(F.col("theme").alias("entry")).distinct().select("entry", exprs.theme_label(F.col("entry")).alias("text"))
    labels = t.spark.createDataFrame(list(fixed.THEME_LABELS.items()), "entry string, text string")
    return S.fuzzy_dictionary(queries, themes.unionByName(labels), 0.25)


@query("k44_v1_search", ", x AS (SELECT 'theme' AS kind, unnest(themes) AS name FROM signals UNION ALL SELECT 'person', unnest(persons) FROM signals UNION ALL SELECT 'country', country_code FROM signals) SELECT kind, name, count(*) AS n FROM x WHERE contains(lower(name), '1') GROUP BY ALL")
def k44(t):
    parts = [t.signals.select(F.lit("theme").alias("kind"), F.explode("themes").alias("name")), t.signals.select(F.lit("person").alias("kind"), F.explode("persons").alias("name")), t.signals.select(F.lit("country").alias("kind"), F.col("country_code").alias("name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.lower("name").contains("1")).groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("h7_merged_hits", ", t AS (SELECT unnest(themes) AS item FROM signals WHERE is_crisis), u AS (SELECT unnest(persons) AS item FROM signals UNION ALL SELECT unnest(themes) FROM signals WHERE event_type = 'click'), a AS (SELECT DISTINCT item, 0 AS source_rank FROM t UNION ALL SELECT DISTINCT item, 1 FROM u) SELECT item, min(source_rank) AS source_rank FROM a GROUP BY ALL")
def h7(t):
    first = R.exploded(t.signals.where("is_crisis")).select(F.col("theme").alias("item")).distinct()
    second = t.signals.select(F.explode("persons").alias("item")).union(R.exploded(t.signals.where("event_type = 'click'")).select("theme")).distinct()
    return S.merged_hits(first, second)


@query("k39_unified_search", ", th AS (SELECT 'theme' AS part, item, total FROM (SELECT item, sum(n) AS total FROM (SELECT item, country_code, count(*) AS n FROM (SELECT country_code, unnest(themes) AS item FROM signals WHERE contains(lower(array_to_string(themes, ' ')), 'click')) GROUP BY ALL HAVING count(*) >= 2) GROUP BY item ORDER BY total DESC, item LIMIT 10)), pg AS (SELECT 'page' AS part, title AS item, sum(views) AS total FROM pageviews WHERE contains(lower(title), 'click') GROUP BY title ORDER BY total DESC, item LIMIT 20), sg AS (SELECT 'signal' AS part, CAST(signal_id AS VARCHAR) AS item, floor(epoch(ts)) AS total FROM signals WHERE contains(lower(headline), 'click') ORDER BY ts DESC, signal_id LIMIT 50), gr AS (SELECT title AS item, " + GRAMS.format("title") + " AS a, " + GRAMS.format("'click'") + " AS b FROM (SELECT DISTINCT title FROM pageviews)), su AS (SELECT 'suggestion' AS part, item, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 3) AS total, CAST((SELECT sum(views) FROM pageviews WHERE title = item) AS BIGINT) AS v FROM gr), s2 AS (SELECT part, item, total FROM su WHERE total >= 0.45 ORDER BY total DESC, v DESC, item LIMIT 5), s3 AS (SELECT * FROM s2 WHERE total >= 0.55 OR NOT EXISTS (SELECT 1 FROM s2 WHERE total >= 0.55)), u AS (SELECT * FROM th UNION ALL SELECT * FROM pg UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM s3) SELECT part, item, CAST(total AS DOUBLE) AS total, CAST(row_number() OVER (PARTITION BY part ORDER BY total DESC, item) AS INTEGER) AS rank FROM u")
def k39(t):
    """One search over everything; this text names no country, region or concept."""
    return S.unified_search(t.signals, t.countries, t.pageviews, "Click")
