"""Queries: scalar functions over the signals, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..operators import happenings as H
from ..operators import rollups as R
from .fixture import AS_OF
from .registry import query


@query("c2_slug_titles", "SELECT page_id, CASE WHEN length(slug) >= 5 AND (contains(slug, '-') OR contains(slug, '_')) THEN 1 ELSE 0 END AS has_title FROM (SELECT page_id, list_last(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')) AS slug FROM pages)")
def c2(t):
    return t.raw("pages").select("page_id", F.when(exprs.slug_title(F.col("url")).isNotNull(), 1).otherwise(0).alias("has_title"))


@query("c2_slug_words", ", s AS (SELECT signal_id, 'http://x.org/a/' || replace(headline, ' ', CASE signal_id % 2 WHEN 0 THEN '-' ELSE '_' END) || CASE signal_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.php?x=a-b' ELSE '/' END AS url FROM signals) SELECT signal_id, array_to_string(list_transform(string_split(replace(replace(regexp_replace(list_last(string_split(trim(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/'), '/')), '\\.html?|\\.php', '', 'g'), '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM s")
def c2w(t):
    """Headlines put into URLs, with file endings, queries and closing slashes, and got back."""
    i = F.col("signal_id")
    slug = F.regexp_replace("headline", " ", F.when(i % 2 == 0, "-").otherwise("_"))
    url = F.concat(F.lit("http://x.org/a/"), slug, F.when(i % 3 == 0, ".html").when(i % 3 == 1, ".php?x=a-b").otherwise("/"))
    return t.signals.select("signal_id", exprs.slug_title(url).alias("title"))


@query("c3_stripped_pages", "SELECT page_id, md5(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS text_md5 FROM pages")
def c3(t):
    return t.raw("pages").select("page_id", F.md5(exprs.strip_tags(F.col("html"))).alias("text_md5"))


@query("c4_search_text", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(translate(text, 'ßœæøłđðþ', '        '))), '[^a-z0-9]+', ' ', 'g'))) AS text_md5 FROM documents")
def c4(t):
    return t.raw("documents").select("doc_id", F.md5(exprs.search_text(F.col("text"))).alias("text_md5"))


@query("c6_singular_words", ", w AS (SELECT DISTINCT lower(unnest(string_split(headline, ' '))) AS word FROM signals) SELECT word, CASE WHEN word LIKE '%virus' THEN word WHEN length(word) > 4 AND word LIKE '%ies' THEN substr(word, 1, length(word) - 3) || 'y' WHEN length(word) > 4 AND word LIKE '%es' THEN substr(word, 1, length(word) - 2) WHEN length(word) > 3 AND word LIKE '%s' THEN substr(word, 1, length(word) - 1) ELSE word END AS one FROM w")
def c6(t):
    words = t.signals.select(F.explode(F.split(F.lower("headline"), " ")).alias("word")).distinct()
    return words.select("word", exprs.singular(F.col("word")).alias("one"))


@query("c7_theme_labels", ", t AS (SELECT DISTINCT unnest(themes) AS theme FROM signals) SELECT theme, CASE WHEN theme LIKE 'SEG\\_%' ESCAPE '\\' THEN 'Seg ' || upper(substr(theme, 5, 1)) || lower(substr(theme, 6)) WHEN theme LIKE 'K%' AND length(theme) = 2 THEN 'K' ELSE upper(substr(theme, 1, 1)) || lower(substr(theme, 2)) END AS label, 'other' AS category FROM t")
def c7(t):
    return R.exploded(t.signals).select("theme").distinct().select("theme", exprs.theme_label(F.col("theme")).alias("label"), exprs.theme_category(F.col("theme")).alias("category"))


@query("c10_coded_labels", "SELECT DISTINCT root_code, quad_class, CASE root_code WHEN '01' THEN 'Statement' WHEN '03' THEN 'Cooperation' ELSE root_code END AS label FROM geo_events")
def c10(t):
    return t.geo_events.select("root_code", "quad_class").distinct().select("root_code", "quad_class", H.coded_label(F.col("root_code"), {"01": "Statement", "03": "Cooperation"}).alias("label"))


@query("c11_url_hashes", "SELECT signal_id, md5(source_url) AS url_hash FROM signals")
def c11(t):
    return t.signals.select("signal_id", F.md5("source_url").alias("url_hash"))


@query("c12_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS tokens FROM documents")
def c12(t):
    return t.raw("documents").select("doc_id", F.size(exprs.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("c13_scripts", "SELECT doc_id, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'arabic' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script, coalesce(lower(lang), 'en') AS lang FROM documents")
def c13(t):
    return t.raw("documents").select("doc_id", exprs.script(F.col("text")).alias("script"), exprs.language_hint(F.col("text"), F.col("lang")).alias("lang"))


@query("c14_clean_titles", "SELECT doc_id, CASE WHEN length(x) >= 3 THEN x END AS title FROM (SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 100) AS x FROM documents)")
def c14(t):
    return t.raw("documents").select("doc_id", exprs.clean_title(F.col("text")).alias("title"))


@query("c24_distances", "SELECT signal_id, round(6371 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km FROM (SELECT signal_id, pow(sin(radians(48.85 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(48.85)) * pow(sin(radians(2.35 - longitude) / 2), 2) AS a FROM signals)")
def c24(t):
    return t.signals.select("signal_id", F.round(exprs.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(48.85), F.lit(2.35)), 3).alias("km"))


@query("c28_buckets", "SELECT signal_id, CAST(time_bucket(INTERVAL 15 MINUTES, ts) AS VARCHAR) AS quarter, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour FROM signals")
def c28(t):
    return t.signals.select("signal_id", F.window("ts", "15 minutes")["start"].cast("string").alias("quarter"), R.hour().cast("string").alias("hour"))


@query("c29_labels", "SELECT signal_id, CASE WHEN x < -10 THEN 'very_negative' WHEN x < -2 THEN 'negative' WHEN x <= 2 THEN 'neutral' WHEN x <= 10 THEN 'positive' ELSE 'very_positive' END AS tone, CASE WHEN sentiment > 0.5 THEN 'positive' WHEN sentiment > -0.5 THEN 'neutral' WHEN sentiment > -2 THEN 'negative' ELSE 'hostile' END AS framing, round(greatest(-1, least(1, x / 10)), 6) AS clamped FROM (SELECT *, sentiment * 3 AS x FROM signals)")
def c29(t):
    x = F.col("sentiment") * 3
    return t.signals.select("signal_id", exprs.tone_label(x).alias("tone"), exprs.framing_label(F.col("sentiment")).alias("framing"), R.r(exprs.clamped_tone(x)).alias("clamped"))


@query("c33_decay", "SELECT signal_id, round(exp(-(epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 3600 / 100), 6) AS decay FROM signals")
def c33(t):
    return t.signals.select("signal_id", R.r(exprs.decay(F.col("ts"), F.to_timestamp(F.lit(AS_OF)), 100.0)).alias("decay"))


@query("c37_conflict_intensity", "SELECT event_id, CAST(round(CAST(greatest(0, least(1, 0.5 - goldstein / 10)) AS DECIMAL(24, 8)), 2) AS DOUBLE) AS intensity FROM geo_events")
def c37(t):
    return t.geo_events.select("event_id", exprs.conflict_intensity(F.col("goldstein")).alias("intensity"))


@query("c38_chosen_sentiment", "SELECT signal_id, coalesce(nlp_sentiment, sentiment) AS tone FROM signals")
def c38(t):
    return t.signals.select("signal_id", F.coalesce("nlp_sentiment", "sentiment").alias("tone"))


@query("c39_gated_tone", "SELECT country_code, round(CASE WHEN count(nlp_sentiment) / count(*) >= 0.34 THEN avg(nlp_sentiment) ELSE avg(sentiment) END, 6) AS tone FROM signals GROUP BY ALL")
def c39(t):
    return t.signals.groupBy("country_code").agg(R.r(exprs.gated_tone(F.avg("nlp_sentiment"), F.avg("sentiment"), F.count("nlp_sentiment"), F.count("*"), 0.34)).alias("tone"))


@query("b11_attention", "SELECT title FROM (SELECT DISTINCT title FROM pageviews) WHERE NOT starts_with(title, 'VIEW')")
def b11(t):
    """Titles of one kind are named after a singer, and go."""
    titles = t.pageviews.select("title").distinct()
    named = titles.withColumn("shown", F.when(F.col("title").startswith("VIEW"), F.concat(F.col("title"), F.lit("_singer"))).otherwise(F.col("title")))
    return named.where(exprs.attention_relevant(F.col("shown"))).select("title")


@query("b7_theme_bundle", "SELECT signal_id FROM signals WHERE list_has_any(themes, ['K2', 'ERROR'])")
def b7(t):
    return t.signals.where(F.arrays_overlap("themes", F.array(F.lit("K2"), F.lit("ERROR")))).select("signal_id")


@query("b6_like_any", "SELECT signal_id FROM signals WHERE contains(lower(headline), 'nation_2') OR contains(lower(headline), 'error')")
def b6(t):
    return t.signals.where(exprs.like_any(F.col("headline"), ["nation_2", "error"])).select("signal_id")


@query("c19_outlet_country", "SELECT page_id, CASE WHEN host LIKE '%.example.net' THEN 'NL' WHEN host LIKE '%.example.com' THEN 'US' END AS home FROM (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1), '^www\\.', '') AS host FROM pages)")
def c19(t):
    return t.raw("pages").select("page_id", exprs.outlet_country(F.col("url"), {"example.net": "NL", "example.com": "US"}).alias("home"))


@query("c18_first_keyword", "SELECT doc_id, CASE WHEN contains(lower(text), 'ción') THEN 'ES' WHEN contains(lower(text), 'eau') THEN 'FR' WHEN contains(lower(text), 'sch') THEN 'DE' ELSE 'XX' END AS country FROM documents")
def c18(t):
    return t.raw("documents").select("doc_id", exprs.first_keyword(F.lower("text"), [("ción", "ES"), ("eau", "FR"), ("sch", "DE")], F.lit("XX")).alias("country"))


@query("b10_visible_persons", ", p AS (SELECT unnest(persons) AS person FROM signals) SELECT person, count(*) AS n FROM p WHERE person <> 'person 3' GROUP BY ALL ORDER BY n DESC, person LIMIT 8")
def b10(t):
    from ..operators.themes import visible_persons

    return visible_persons(R.exploded(t.signals, "persons", "person").groupBy("person").agg(F.count("*").alias("n")), ["person 3"])


@query("b3_focus_person", "SELECT signal_id FROM signals WHERE len(list_filter(persons, lambda p: contains(lower(p), 'person 12'))) > 0")
def b3(t):
    return t.signals.where(exprs.focus("person", "Person 12")).select("signal_id")


ENTITIES = ", e AS (SELECT signal_id, unnest(list_concat(persons, [headline, source_family, CAST(signal_id AS VARCHAR), 'G7', 'x', 'one two three four five six', concat('Дума ', CAST(signal_id % 3 AS VARCHAR)), 'abcdefgé', 'éèç', ' EU '])) AS name, CASE signal_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' END AS lang FROM signals), v AS (SELECT * FROM e WHERE length(trim(name)) >= 2 AND NOT regexp_matches(trim(name), '^[0-9]+$') AND len(string_split_regex(trim(name), '\\s+')) <= 5 AND (lang = 'ar' OR (lang IS DISTINCT FROM 'ar' AND length(regexp_replace(trim(name), '[\\x00-\\x7F]', '', 'g')) / length(trim(name)) < 0.4)))"


def _entities(t):
    k = F.col("signal_id") % 3
    more = F.array("headline", "source_family", F.col("signal_id").cast("string"), F.lit("G7"), F.lit("x"), F.lit("one two three four five six"), F.concat(F.lit("Дума "), k.cast("string")), F.lit("abcdefgé"), F.lit("éèç"), F.lit(" EU "))
    return t.signals.select("signal_id", F.explode(F.concat("persons", more)).alias("name"), F.when(k == 0, "en").when(k == 1, "ar").alias("lang"))


@query("b14_valid_entities", ENTITIES + " SELECT DISTINCT name, lang FROM v")
def b14(t):
    """Short names, numbers, other scripts, in rows of three languages."""
    return _entities(t).where(exprs.entity_valid(F.col("name"), F.col("lang"))).select("name", "lang").distinct()


@query("l5_clean_entities", ENTITIES + ", w AS (SELECT * FROM (SELECT signal_id, name, lang FROM v UNION ALL SELECT signal_id, upper(name), lang FROM v)) SELECT signal_id, min(name) AS name FROM w GROUP BY signal_id, lower(name)")
def l5(t):
    """Each name twice, in other case; the smaller spelling stays."""
    from ..operators.enrich import clean_entities

    e = _entities(t).withColumn("type", F.lit("PERSON"))
    return clean_entities(e.unionByName(e.withColumn("name", F.upper("name"))).unionByName(e.withColumn("type", F.lit("DATE")))).select("signal_id", "name")


@query("c8_simple_labels", ", t AS (SELECT DISTINCT unnest(themes) AS theme FROM signals) SELECT theme, CASE WHEN theme LIKE 'SEG%' THEN 'Seg ' || upper(substr(theme, 5, 1)) || lower(substr(theme, 6)) WHEN length(theme) = 2 THEN 'K' ELSE upper(substr(theme, 1, 1)) || lower(substr(theme, 2)) END AS label FROM t")
def c8(t):
    return R.exploded(t.signals).select("theme").distinct().select("theme", exprs.simple_label(F.col("theme")).alias("label"))


@query("c21_centroid_fallback", "SELECT signal_id, CASE WHEN signal_id % 2 = 0 THEN s.latitude ELSE c.latitude END AS latitude FROM signals s LEFT JOIN countries c USING (country_code)")
def c21(t):
    from ..operators.themes import with_place

    some = t.signals.withColumn("latitude", F.when(F.col("signal_id") % 2 == 0, F.col("latitude")))
    return with_place(some, t.countries).select("signal_id", "latitude")


@query("c23_query_country", "SELECT signal_id, CASE event_type WHEN 'click' THEN 'KR' WHEN 'view' THEN 'US' END AS code FROM signals")
def c23(t):
    text = F.concat_ws(" ", "headline", F.when(F.col("event_type") == "click", "in South Korea").when(F.col("event_type") == "view", "sobre Estados Unidos"))
    # the given table may be one small file; its rows are dealt over the cores first
    rows = t.signals.select("signal_id", text.alias("asked")).repartition(t.spark.sparkContext.defaultParallelism)
    return rows.select("signal_id", exprs.country_code(F.col("asked")).alias("code"))


CALLSIGNS = [*[x + "12" for x in fixed.MILITARY_PREFIXES], *[x + "1" for x in fixed.GOVERNMENT_PREFIXES], " rch12", "DLH44", "BA9", "N-1", "", "raF", "NATO", "SPARK", "A1", "ABCD1"]
ADDRESSES = ["3c12", "AE12", "af00", "43ff", "4", "", "a3af"]


@query("c27_aircraft_classes", f", x AS (SELECT signal_id, upper(trim(unnest([{', '.join(repr(c) for c in CALLSIGNS)}]))) AS cs, [{', '.join(repr(a) for a in ADDRESSES)}][signal_id % {len(ADDRESSES)} + 1] AS ad FROM signals) SELECT signal_id, cs, CASE WHEN list_has_any([left(cs, 2), left(cs, 3), left(cs, 4)], {fixed.MILITARY_PREFIXES}) THEN 'military' WHEN list_has_any([left(cs, 3), left(cs, 4)], {fixed.GOVERNMENT_PREFIXES}) THEN 'government' WHEN lower(left(ad, 2)) IN ('ae', 'af', '43') THEN 'military' WHEN regexp_matches(cs, '^[A-Z]{{2,3}}[0-9]') THEN 'commercial' ELSE 'private' END AS kind FROM x")
def c27(t):
    """Every callsign of the tables, and others, with addresses in and out of the ranges."""
    rows = t.signals.select("signal_id", F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.col("signal_id") % len(ADDRESSES) + 1).cast("int")).alias("ad"), F.explode(F.array(*map(F.lit, CALLSIGNS))).alias("c"))
    return rows.select("signal_id", F.upper(F.trim("c")).alias("cs"), exprs.aircraft_class(F.col("c"), F.col("ad")).alias("kind"))


@query("c31_precision", "SELECT signal_id, CASE signal_id % 6 WHEN 1 THEN 'country' WHEN 2 THEN 'region' WHEN 5 THEN 'region' WHEN 0 THEN 'unknown' ELSE 'city' END AS place FROM signals")
def c31(t):
    return t.signals.select("signal_id", exprs.precision(F.col("signal_id") % 6).alias("place"))


@query("c35_theme_intensity", ", m AS (SELECT country_code, theme, count(*) AS n FROM (SELECT country_code, unnest(themes) AS theme FROM signals) GROUP BY ALL) SELECT country_code, round(least(1, sum(n) / 500), 6) AS intensity FROM m GROUP BY ALL")
def c35(t):
    per = R.exploded(t.signals).groupBy("country_code", "theme").agg(F.count("*").alias("n"))
    maps = per.groupBy("country_code").agg(F.map_from_entries(F.collect_list(F.struct("theme", "n"))).alias("m"))
    return maps.select("country_code", R.r(exprs.intensity(F.col("m"))).alias("intensity"))


@query("c36_source_confidence", "SELECT signal_id, round(0.7 + CASE WHEN source_lang IS NOT NULL THEN 0.15 ELSE 0 END + 0.15, 2) AS confidence FROM signals")
def c36(t):
    return t.signals.select("signal_id", exprs.source_confidence(F.col("source_url").isNotNull(), F.col("source_lang").isNotNull(), F.col("ts").isNotNull()).alias("confidence"))


@query("c41_signed_scores", "SELECT signal_id, round(5 * (geo_confidence - (1 - geo_confidence)), 6) AS score, round(greatest(geo_confidence, 1 - geo_confidence), 6) AS confidence FROM signals")
def c41(t):
    s = exprs.signed_score(F.create_map(F.lit("positive"), F.col("geo_confidence"), F.lit("negative"), 1 - F.col("geo_confidence")))
    return t.signals.select("signal_id", R.r(s["score"]).alias("score"), R.r(s["confidence"]).alias("confidence"))


@query("d3_routed_totals", "SELECT country_code, count(*) AS n FROM signals WHERE date_trunc('day', ts) > TIMESTAMP '2024-01-31' - INTERVAL 480 HOURS GROUP BY ALL")
def d3(t):
    """A window of 20 days, which the daily rollup answers."""
    from ..operators.themes import totals_routed

    return totals_routed(t.signals, R.country_hourly(t.signals), R.country_daily(t.signals), AS_OF, 480)
