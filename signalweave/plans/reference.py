"""Queries that run the given rows through the whole reference tables; their SQL has the same tables as values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..operators import enrich as E
from ..operators import finding as S
from ..operators import happenings as H
from ..operators import rollups as R
from ..operators import themes as T
from .fixture import AS_OF
from .heat import NOW
from .registry import query

QUOTED = lambda x: "'" + str(x).replace("'", "''") + "'"
LIST = lambda xs: "[" + ", ".join(map(QUOTED, xs)) + "]"
#: Rows of values for DuckDB; a list becomes a list.
VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(LIST(x) if isinstance(x, (list, tuple)) else str(x) if isinstance(x, (int, float)) else QUOTED(x) for x in row) + ")" for row in rows) + ")"


def dealt(t, values: list[str], name: str):
    """Every signal with one of the values, in turn."""
    at = (F.col("signal_id") % len(values) + 1).cast("int")
    return t.signals.withColumn(name, F.element_at(F.array(*map(F.lit, values)), at))


def dealt_sql(values: list[str], name: str) -> str:
    return f", x AS (SELECT *, {LIST(values)}[signal_id % {len(values)} + 1] AS {name} FROM signals)"


FIPS = [*fixed.FIPS_TO_ISO, "US", "fr", "QQ", "", " in"]


@query("c17_iso_codes", dealt_sql(FIPS, "fips") + f", m AS (SELECT * FROM {VALUES(fixed.FIPS_TO_ISO.items())} m(fips, iso)) SELECT signal_id, coalesce(iso, nullif(upper(trim(x.fips)), '')) AS iso FROM x LEFT JOIN m ON m.fips = x.fips")
def c17(t):
    return dealt(t, FIPS, "fips").select("signal_id", exprs.iso_country(F.col("fips")).alias("iso"))


THEMES = [*fixed.THEME_LABELS, "CRISISLEX_CRISISLEXREC", "crime"]


@query("c7_taxonomy_labels", dealt_sql(THEMES, "theme") + f", m AS (SELECT * FROM {VALUES([*fixed.THEME_LABELS.items(), ('CRISISLEX_CRISISLEXREC', 'Crisis Event'), ('crime', 'Crime')])} m(code, label)) SELECT theme, label, count(*) AS n FROM x JOIN m ON code = theme GROUP BY ALL")
def c7(t):
    return dealt(t, THEMES, "theme").select("theme", exprs.theme_label(F.col("theme")).alias("label")).groupBy("theme", "label").agg(F.count("*").alias("n"))


CODES = [*fixed.EVENT_CODE_LABELS, "0219", "1999", "99", "0", "42"]


@query("c10_event_labels", dealt_sql(CODES, "code") + f", m AS (SELECT * FROM {VALUES(fixed.EVENT_CODE_LABELS.items())} m(k, label)), c AS (SELECT DISTINCT code, CASE WHEN length(code) < 3 THEN lpad(code, 3, '0') ELSE code END AS k FROM x) SELECT code, coalesce(a.label, b.label, 'Action ' || c.k) AS label FROM c LEFT JOIN m a ON a.k = c.k LEFT JOIN m b ON b.k = substr(c.k, 1, 3)")
def c10(t):
    return dealt(t, CODES, "code").select("code").distinct().select("code", H.event_label(F.col("code")).alias("label"))


FAMILIES = ["https://www." + d + "/a" for d in fixed.SOURCE_FAMILY] + ["http://x.state.gov/a", "https://y.gob.mx/", "https://plain.org/z", "https://en.rt.com/q"]


@query("c25_source_families", dealt_sql(FAMILIES, "url") + f", m AS (SELECT * FROM {VALUES(fixed.SOURCE_FAMILY.items())} m(host, family)), h AS (SELECT signal_id, regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www\\.', '') AS host FROM x) SELECT signal_id, coalesce(family, CASE WHEN host LIKE '%.gov' OR host LIKE '%.gob.mx' THEN 'state' ELSE 'independent' END) AS family FROM h LEFT JOIN m USING (host)")
def c25(t):
    return dealt(t, FAMILIES, "url").select("signal_id", exprs.source_family(F.col("url")).alias("family"))


HOSTS = [x for d in fixed.BLOCKED_DOMAINS for x in (d, "sub." + d, "not" + d)]


@query("b8_blocklist", dealt_sql(HOSTS, "host") + f", m AS (SELECT unnest({LIST(fixed.BLOCKED_DOMAINS)}) AS d) SELECT signal_id, host FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE host = d OR ends_with(host, '.' || d))")
def b8(t):
    return dealt(t, HOSTS, "host").where(~exprs.blocked(F.concat(F.lit("https://"), "host", F.lit("/x")))).select("signal_id", "host")


NAMES = [*fixed.PLACE_NAMES, "Angela Merkel", "Greater Manchester", "upper austria", "Cher", "Anna " + "x" * 60, "Rio De Janeiro", "José  Pérez"]


@query("b9_valid_persons", dealt_sql(NAMES, "person") + f" SELECT signal_id, person FROM x WHERE len(string_split_regex(trim(person), '\\s+')) >= 2 AND length(person) <= 60 AND lower(person) NOT IN (SELECT unnest({LIST(fixed.PLACE_NAMES)})) AND string_split(lower(person), ' ')[1] NOT IN (SELECT unnest({LIST(fixed.PLACE_FIRST_WORDS)}))")
def b9(t):
    return dealt(t, NAMES, "person").where(exprs.valid_person(F.col("person"))).select("signal_id", "person")


ASKED = ["protests in " + a for a in fixed.COUNTRY_ALIASES]


@query("c23_country_aliases", dealt_sql(ASKED, "asked") + f", m AS (SELECT * FROM {VALUES(fixed.COUNTRY_ALIASES.items())} m(alias, code)) SELECT signal_id, code FROM x JOIN m ON asked = 'protests in ' || alias")
def c23(t):
    rows = dealt(t, ASKED, "asked").select("signal_id", "asked").repartition(t.spark.sparkContext.defaultParallelism)
    return rows.select("signal_id", exprs.country_code(F.col("asked")).alias("code"))


SENTIMENT = [f"talks on {w} went on today" for w in ("war", "peace", "ceasefire and aid", "nothing", "famine, drought and panic")] + ["habrá acuerdo de paz y ayuda", "la guerra y la hambruna"]
WEIGHED = ", ".join(f"('{g}', {QUOTED(w)}, {float(x)}::DOUBLE)" for g, ws in fixed.LEXICON.items() for w, x in ws.items())


@query("l1_lexicon_whole", dealt_sql(SENTIMENT, "said") + f", lx AS (SELECT * FROM (VALUES {WEIGHED}) v(lang, word, weight)), w AS (SELECT signal_id, CASE WHEN source_lang IN ('en', 'es', 'fr', 'pt', 'ar') THEN source_lang ELSE 'en' END AS lang, unnest(regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM x), s AS (SELECT signal_id, greatest(-5, least(5, sum(weight))) AS s FROM w JOIN lx USING (lang, word) GROUP BY ALL) SELECT signal_id, round(s, 3) AS score, round(least(0.5, 0.5 * abs(s) / 5), 3) AS confidence FROM s")
def l1(t):
    """Texts in the rows' languages, by the whole lexicons."""
    return E.lexicon_sentiment(dealt(t, SENTIMENT, "said"), "signal_id", "said", "source_lang", E.lexicon_frame(t.spark))


TOPIC_TEXTS = [f"{terms[0]} reported, {terms[-1]} feared" for _, _, terms, _ in fixed.TOPIC_SEEDS.values()]
TOPICS = VALUES([(k, terms, hints) for k, (_, _, terms, hints) in fixed.TOPIC_SEEDS.items()])


@query("l7_seed_topics", dealt_sql(TOPIC_TEXTS, "title") + f", tp AS (SELECT * FROM {TOPICS} v(topic, terms, hints)), sx AS (SELECT signal_id, title, CASE signal_id % 3 WHEN 0 THEN 'PROTEST' WHEN 1 THEN 'HEALTH' ELSE 'X' END AS theme FROM x), a AS (SELECT signal_id, topic, len(list_filter(terms, lambda w: regexp_matches(title, '\\b' || w || '\\b'))) AS k, len(terms) AS n, list_contains(hints, theme) AS hint FROM sx, tp), c AS (SELECT signal_id, topic, round(least(1, k / n + CASE WHEN hint THEN 0.5 ELSE 0 END), 6) AS confidence FROM a WHERE k > 0 OR hint) SELECT * FROM c WHERE confidence >= 0.2")
def l7(t):
    """Titles that hold the first and the last term of a topic, terms of up to three words."""
    theme = F.when(F.col("signal_id") % 3 == 0, "PROTEST").when(F.col("signal_id") % 3 == 1, "HEALTH").otherwise("X")
    rows = dealt(t, TOPIC_TEXTS, "title").select("signal_id", F.col("title").alias("headline"), F.array(theme).alias("themes"))
    return E.assign_topics(rows, E.topic_frame(t.spark)).select("signal_id", "topic", "confidence")


BUNDLED = sorted({c for x in fixed.CONCEPTS.values() for c in x["themes"]})
CONCEPT_ROWS = VALUES([(k, x["themes"]) for k, x in fixed.CONCEPTS.items()])


@query("k12_concepts", dealt_sql(BUNDLED, "theme") + f", c AS (SELECT slug, unnest(themes) AS theme FROM {CONCEPT_ROWS} v(slug, themes)) SELECT slug, country_code, count(*) AS signal_count, round(avg(sentiment), 6) AS tone, count(DISTINCT source_name) AS sources FROM x JOIN c USING (theme) WHERE {NOW(480)} GROUP BY ALL")
def k12(t):
    """Every concept's countries at once, over rows that each have one theme of a bundle."""
    rows = dealt(t, BUNDLED, "theme").withColumn("themes", F.array("theme")).drop("theme")
    return T.concepts_by_country(rows, S.concept_frame(t.spark), AS_OF, 480)


REGION_TEXTS = [*fixed.SEARCH_REGIONS, *(a for x in fixed.SEARCH_REGIONS.values() for a in x["aliases"]), "africa floods", "new trade in asia", "nothing"]


@query("c22_region_search", dealt_sql(REGION_TEXTS, "asked") + ", q AS (SELECT DISTINCT asked AS query, trim(lower(strip_accents(asked))) AS name FROM x), n AS (SELECT *, trim(lower(strip_accents(raw))) AS name FROM " + VALUES([(i, j, slug, a, j <= 1) for i, (slug, x) in enumerate(fixed.SEARCH_REGIONS.items()) for j, a in enumerate([slug, slug.replace("-", " "), *x["aliases"]])]).replace("True", "true").replace("False", "false") + " v(i, j, region, raw, is_slug)), ws AS (SELECT query, list_distinct(list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda w: length(w) > 1)) AS w FROM q), nw AS (SELECT i, j, region, list_distinct(list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda w: length(w) > 1)) AS w FROM n WHERE NOT is_slug), a AS (SELECT query, i, j, region, 2.0 AS s FROM q JOIN n USING (name) UNION ALL SELECT query, i, j, region, len(list_intersect(ws.w, nw.w)) / len(ws.w) FROM ws, nw WHERE len(ws.w) > 0 AND len(list_intersect(ws.w, nw.w)) / len(ws.w) >= 0.5) SELECT query, region FROM a QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, i, j) = 1")
def c22(t):
    return S.search_regions(dealt(t, REGION_TEXTS, "asked").select(F.col("asked").alias("query")))


CONCEPT_TEXTS = [*fixed.CONCEPTS, *(x["aliases"][0] for x in fixed.CONCEPTS.values()), "viollence", "diamnts of blood", "kill", "zz"]


@query("k38_concept_search")
def k38(t):
    """Queries dealt to the rows against all concepts; held against plain code in the tests."""
    return S.fuzzy_concepts(dealt(t, CONCEPT_TEXTS, "asked").select(F.col("asked").alias("query")).distinct(), S.concept_frame(t.spark))


@query("k38_closest_concepts")
def k38c(t):
    """What is nearest to each headline's first word; held against plain code in the tests."""
    return S.closest_concepts(t.signals.select(F.substring_index("headline", " ", 3).alias("query")).distinct(), S.concept_frame(t.spark))
