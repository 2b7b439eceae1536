"""Queries: enrichment, retention, quality, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import enrich as E
from ..operators import pairs as P
from ..operators import quality as Q
from ..operators import rollups as R
from ..sources import sinks as K
from .aggregates import EXPLODED, HOUR
from .fixture import AS_OF
from .heat import NOW, ROUND2
from .pairs import GRID
from .registry import query

LEX = {"en": {"click": 2.0, "error": -2.5, "the": 0.5, "of": -0.25}, "fr": {"de": -0.5, "le": 1.0}, "de": {"der": 0.75}, "es": {"la": 1.5, "que": -1.0}}
LEX_ROWS = "(VALUES " + ", ".join(f"('{g}', '{w}', {x}::DOUBLE)" for g, ws in LEX.items() for w, x in ws.items()) + ") lx(lang, word, weight)"


def _lexicon_sql(table, key, text, lang):
    return f", d AS (SELECT {key}, CASE WHEN lower({lang}) IN ('en', 'fr', 'de', 'es') THEN lower({lang}) WHEN regexp_matches({text}, '[؀-ۿ]') THEN 'ar' ELSE 'en' END AS lang, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {table}), w AS (SELECT {key}, lang, unnest(ws) AS word FROM d WHERE len(ws) >= 3), s AS (SELECT {key}, sum(weight) AS s FROM w JOIN {LEX_ROWS} USING (lang, word) GROUP BY ALL) SELECT {key}, round(greatest(-5, least(5, s)), 3) AS score, round(least(0.5, 0.5 * abs(greatest(-5, least(5, s))) / 5), 3) AS confidence FROM s"


@query("l1_lexicon_headlines", _lexicon_sql("signals", "signal_id", "headline", "CAST(NULL AS VARCHAR)"))
def l1(t):
    return E.lexicon_sentiment(t.signals.withColumn("lang", F.lit(None).cast("string")), "signal_id", "headline", "lang", E.lexicon_frame(t.spark, LEX), languages=list(LEX))


@query("l1_lexicon_documents", _lexicon_sql("documents", "doc_id", "text", "lang"))
def l1d(t):
    return E.lexicon_sentiment(t.raw("documents"), "doc_id", "text", "lang", E.lexicon_frame(t.spark, LEX), languages=list(LEX))


@query("l2_nlp_batch", f""", a AS (SELECT *, (epoch({{AS_OF}}) - epoch(ts)) / 86400 + CASE WHEN source_lang <> 'en' THEN -2 ELSE 0 END + CASE WHEN source_family IN ('api', 'social') THEN -1 ELSE 0 END + CASE WHEN geo_confidence > 0.8 THEN -0.5 ELSE 0 END AS p FROM signals WHERE nlp_sentiment IS NULL AND length(headline) > 10),
 sm AS (SELECT signal_id FROM (SELECT * FROM signals ORDER BY ts DESC, signal_id LIMIT 75000) QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), country_code ORDER BY ts DESC, signal_id) <= 3), h AS (SELECT signal_id, 'hot' AS lane FROM a WHERE {NOW(72)} ORDER BY p, signal_id LIMIT 130), s AS (SELECT signal_id, 'sample' AS lane FROM a WHERE signal_id IN (SELECT signal_id FROM sm) AND signal_id NOT IN (SELECT signal_id FROM h) ORDER BY ts, signal_id LIMIT 50),
 b AS (SELECT signal_id, 'backlog' AS lane FROM a WHERE ts > {{AS_OF}} - INTERVAL 20 DAYS AND ts <= {{AS_OF}} - INTERVAL 72 HOURS AND signal_id NOT IN (SELECT signal_id FROM h UNION ALL SELECT signal_id FROM s) ORDER BY p, signal_id LIMIT 200), u AS (SELECT *, 0 AS o FROM h UNION ALL SELECT *, 1 FROM s UNION ALL SELECT *, 2 FROM b) SELECT signal_id, lane FROM (SELECT u.*, p FROM u JOIN a USING (signal_id) ORDER BY o, p, signal_id LIMIT 200)""")
def l2(t):
    return E.nlp_batch(t.signals, R.stratified_sample(t.signals, ["country_code"]), AS_OF, 200, hot_hours=72, backlog_days=20)


@query("l4_scored_rows", "SELECT signal_id, length(headline) AS score FROM signals")
def l4(t):
    """A scorer that counts letters stands for a model."""
    return E.score(t.signals.select("signal_id", "headline"), lambda b: b.assign(score=b.headline.str.len())[["signal_id", "score"]], "signal_id long, score long")


@query("l6_nlp_progress", f"SELECT count(*) FILTER (WHERE nlp_sentiment IS NULL) AS pending, count(*) FILTER (WHERE nlp_sentiment IS NULL AND {NOW(24)}) AS pending_24h, count(*) AS total, {ROUND2('(epoch({AS_OF}) - epoch(min(ts) FILTER (WHERE nlp_sentiment IS NULL))) / 3600')} AS lag_hours FROM signals")
def l6(t):
    return E.nlp_progress(t.signals, AS_OF)


@query("l7_assign_topics", ", tp AS (SELECT * FROM (VALUES ('clicks', ['click', 'nation', 'sale'], ['K1', 'CLICK']), ('errors', ['error', 'in'], ['ERROR'])) x(topic, terms, hints)), w AS (SELECT DISTINCT signal_id, unnest(regexp_extract_all(lower(headline), '[\\p{L}\\p{N}_]+')) AS word FROM signals), b AS (SELECT signal_id, topic, count(*) / len(terms) AS c, list(word) AS w FROM w JOIN tp ON list_contains(terms, word) GROUP BY signal_id, topic, len(terms)), th AS (SELECT DISTINCT signal_id, unnest(themes) AS theme FROM signals), h AS (SELECT signal_id, topic, 0.5 AS c, list(theme) AS w FROM th JOIN tp ON list_contains(hints, theme) GROUP BY ALL), u AS (SELECT * FROM b UNION ALL SELECT * FROM h), g AS (SELECT signal_id, topic, round(least(1, sum(c)), 6) AS confidence, array_to_string(list_sort(flatten(list(w))), ',') AS evidence FROM u GROUP BY ALL) SELECT * FROM g WHERE confidence >= 0.2")
def l7(t):
    topics = t.spark.createDataFrame([("clicks", ["click", "nation", "sale"], ["K1", "CLICK"]), ("errors", ["error", "in"], ["ERROR"])], "topic string, terms array<string>, hints array<string>")
    return E.assign_topics(t.signals, topics)


@query("l8_simple_summary", ", r AS (SELECT *, row_number() OVER (PARTITION BY country_code, event_type ORDER BY ts, signal_id) AS rk FROM signals) SELECT country_code, event_type, string_agg(headline, '; ' ORDER BY rk) FILTER (WHERE rk <= 3) AS summary, string_agg(source_url, ' ' ORDER BY rk) FILTER (WHERE rk <= 5) AS citations FROM r GROUP BY ALL")
def l8(t):
    return E.simple_summary(t.signals, ["country_code", "event_type"])


@query("k50_topic_clusters")
def k50(t):
    """k-means over all headlines; tested for totals and stable labels."""
    return E.topic_clusters(t.signals.select(F.col("headline").alias("title")))


@query("k51_low_volume", f"SELECT country_code, count(*) AS n FROM signals WHERE {NOW(168)} GROUP BY ALL HAVING count(*) < 90")
def k51(t):
    return Q.low_volume_countries(t.signals, AS_OF, below=90)


@query("k45_hotspot_entities", "SELECT person, count(*) AS n FROM (SELECT unnest(persons) AS person FROM signals WHERE country_code = 'N01') GROUP BY ALL ORDER BY n DESC, person LIMIT 10")
def k45(t):
    return Q.explain_hotspot(t.signals, "N01")["entities"]


@query("k47_system_stats", f"SELECT count(*) FILTER (WHERE {NOW(1)}) AS n_1h, count(*) FILTER (WHERE {NOW(24)}) AS n_24h, count(*) FILTER (WHERE {NOW(168)}) AS n_7d, count(DISTINCT country_code) AS countries, count(DISTINCT source_name) AS sources, CAST(min(ts) AS VARCHAR) AS oldest, CAST(max(ts) AS VARCHAR) AS newest FROM signals")
def k47(t):
    return Q.system_stats(t.signals, AS_OF).withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query("k47_freshness", f"SELECT CAST(max(ts) AS VARCHAR) AS newest, {ROUND2('(epoch({AS_OF}) - epoch(max(ts))) / 60')} AS lag_minutes, CASE WHEN lag_minutes <= 30 THEN 'healthy' WHEN lag_minutes <= 120 THEN 'low' ELSE 'stalled' END AS status FROM signals")
def k47f(t):
    return Q.freshness(t.signals, AS_OF).withColumn("newest", F.col("newest").cast("string"))


@query("k48_nlp_calibration", "SELECT coalesce(source_lang, 'unknown') AS source_lang, source_family AS nlp_method, count(*) AS corrections, round(avg(abs(CASE WHEN signal_id % 3 = 0 THEN NULL ELSE sentiment + 0.5 END - sentiment)), 6) AS avg_delta, round(avg(CASE WHEN 'frame_1' <> nlp_framing THEN 1 ELSE 0 END), 6) AS framing_rate FROM signals WHERE signal_id % 2 = 0 GROUP BY ALL")
def k48(t):
    s = t.signals.withColumn("nlp_method", F.col("source_family"))
    corrections = s.where("signal_id % 2 = 0").select("signal_id", F.col("sentiment").alias("original_sentiment"), F.when(F.col("signal_id") % 3 != 0, F.col("sentiment") + 0.5).alias("corrected_sentiment"), F.col("nlp_framing").alias("original_framing"), F.lit("frame_1").alias("corrected_framing"))
    return Q.nlp_calibration(corrections, s)


@query("n1_retention", "SELECT CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS day, count(*) AS n FROM signals WHERE ts < {AS_OF} - INTERVAL 14 DAYS GROUP BY ALL")
def n1(t):
    return HOUR(K.drop_older(t.signals, AS_OF, 14, enabled=False)[1])


@query("n2_hourly_retention", "SELECT count(*) AS hours FROM (SELECT DISTINCT country_code, date_trunc('hour', ts) AS hour FROM signals) WHERE hour >= {AS_OF} - INTERVAL 14 DAYS")
def n2(t):
    return K.drop_older(R.country_hourly(t.signals), AS_OF, 14, True, "hour")[0].agg(F.count("*").alias("hours"))


@query("n3_prune_unenriched", "SELECT source_family, count(*) AS n FROM signals WHERE ts < {AS_OF} - INTERVAL 15 DAYS AND nlp_sentiment IS NULL GROUP BY ALL")
def n3(t):
    return Q.prune_unenriched(t.signals, AS_OF, 15)[1]


@query("n4_age_distribution", ", a AS (SELECT CASE WHEN (epoch({AS_OF}) - epoch(ts)) / 86400 <= 7 THEN '0-7d' WHEN (epoch({AS_OF}) - epoch(ts)) / 86400 <= 14 THEN '7-14d' WHEN (epoch({AS_OF}) - epoch(ts)) / 86400 <= 21 THEN '14-21d' ELSE '>21d' END AS age FROM signals) SELECT age, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM a GROUP BY ALL")
def n4(t):
    return Q.age_distribution(t.signals, AS_OF, (7, 14, 21))


@query("n5_duplicate_share", f"SELECT count(*) AS n, {ROUND2('100.0 * (1 - count(DISTINCT source_url) / count(source_url))')} AS duplicate_pct FROM signals")
def n5(t):
    return Q.quality_report(t.signals, AS_OF)["volume"]


@query("n5_top_sources", "SELECT source_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM signals GROUP BY ALL ORDER BY n DESC, source_name LIMIT 10")
def n5s(t):
    return Q.quality_report(t.signals, AS_OF)["sources"]


@query("n6_violations", "SELECT signal_id, 'longitude_range' AS rule FROM signals WHERE longitude + signal_id % 50 > 180 OR longitude + signal_id % 50 < -180 UNION ALL SELECT signal_id, 'latitude_range' FROM signals WHERE latitude * 1.7 NOT BETWEEN -90 AND 90 UNION ALL SELECT signal_id, 'confidence_range' FROM signals WHERE geo_confidence + 0.15 > 1")
def n6(t):
    odd = t.signals.withColumn("longitude", F.col("longitude") + F.col("signal_id") % 50).withColumn("latitude", F.col("latitude") * 1.7).withColumn("geo_confidence", F.col("geo_confidence") + 0.15)
    return Q.violations(odd, Q.signal_rules(), "signal_id")


@query("n7_crisis_backfill", ", s AS (SELECT signal_id, list_concat(themes, CASE signal_id % 5 WHEN 0 THEN ['KILL'] WHEN 1 THEN ['WB_FLOOD', 'X'] ELSE CAST([] AS VARCHAR[]) END) AS th FROM signals) SELECT signal_id, signal_id % 5 IN (0, 1) AS is_crisis, CASE signal_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CASE signal_id % 5 WHEN 0 THEN 'violence' WHEN 1 THEN 'natural_disaster' ELSE 'other' END AS event_type, round(CASE signal_id % 5 WHEN 0 THEN 1 / len(th) + 0.2 WHEN 1 THEN 1 / len(th) + 0.1 ELSE 0 END, 6) AS crisis_score FROM s")
def n7(t):
    from ..sources.normalize import crisis_backfill

    k = F.col("signal_id") % 5
    more = F.when(k == 0, F.array(F.lit("KILL"))).when(k == 1, F.array(F.lit("WB_FLOOD"), F.lit("X"))).otherwise(F.array().cast("array<string>"))
    rows = crisis_backfill(t.signals.select("signal_id", F.concat("themes", more).alias("themes")))
    return rows.select("signal_id", "is_crisis", "severity", "event_type", R.r(F.col("crisis_score")).alias("crisis_score"))


@query("n8_row_counts", "SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'signals', count(*) FROM signals")
def n8(t):
    return Q.row_counts({"documents": t.raw("documents"), "events": t.raw("events"), "pages": t.raw("pages"), "signals": t.signals})


@query("n9_grid_sanity", GRID.replace("count(*)::DOUBLE AS i", "count(*) * 0.05 AS i") + " SELECT CAST(q AS INTEGER) AS q, 'intensity_range' AS rule, count(*) AS broken FROM o WHERE round(v, 6) > 1 GROUP BY ALL")
def n9(t):
    """A grid that is not normalised: its dense cells are over 1."""
    cells = P.grid_smooth(t.signals.select("latitude", "longitude", F.lit(0.05).alias("intensity")), normalise=False)
    return Q.violations(cells, Q.grid_rules(), "q").groupBy("q", "rule").agg(F.count("*").alias("broken"))


@query("b4_signal_list", "SELECT signal_id FROM signals WHERE country_code IN ('N01', 'N02') AND list_contains(themes, 'CLICK') ORDER BY ts DESC, signal_id LIMIT 100")
def b4(t):
    return t.signals.where(F.col("country_code").isin("N01", "N02") & exprs.focus("theme", "CLICK")).orderBy(F.desc("ts"), "signal_id").limit(100).select("signal_id")


@query("b8_not_blocked", "SELECT signal_id FROM signals WHERE source_name NOT IN ('src3.example.com', 'src4.example.com')")
def b8(t):
    return t.signals.where(~exprs.blocked(F.col("source_url"), ["src3.example.com", "src4.example.com", "ple.com"])).select("signal_id")


@query("b18_narratives_for_country", EXPLODED + ", c AS (SELECT theme, country_code FROM t GROUP BY theme, country_code QUALIFY row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, country_code) <= 3) SELECT theme FROM c WHERE country_code = 'N01'")
def b18(t):
    top = R.top_per(R.exploded(t.signals).groupBy("theme", "country_code").agg(F.count("*").alias("n")), ["theme"], [F.desc("n"), F.asc("country_code")], 3)
    return top.groupBy("theme").agg(F.collect_list("country_code").alias("cs")).where(F.array_contains("cs", "N01")).select("theme")
