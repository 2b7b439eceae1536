"""Queries: events, conflicts, searches, page views, crises, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, exprs
from ..operators import happenings as H
from .fixture import AS_OF
from .heat import BASE, NOW, ROUND2
from .registry import query


@query("k27_event_clusters", f""", e AS (SELECT * FROM geo_events WHERE {NOW(480)}), b AS (SELECT country_code, quad_class, count(*) AS event_count, {ROUND2('avg(goldstein)')} AS avg_goldstein, CAST(sum(num_mentions) AS BIGINT) AS mentions, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon, array_to_string(list_sort(list(DISTINCT root_code)), ',') AS root_codes FROM e GROUP BY ALL HAVING count(*) >= 3),
 a1 AS (SELECT country_code, quad_class, actor1 AS top_actor1 FROM e GROUP BY country_code, quad_class, actor1 QUALIFY row_number() OVER (PARTITION BY country_code, quad_class ORDER BY count(*) DESC, actor1) = 1), a2 AS (SELECT country_code, quad_class, actor2 AS top_actor2 FROM e GROUP BY country_code, quad_class, actor2 QUALIFY row_number() OVER (PARTITION BY country_code, quad_class ORDER BY count(*) DESC, actor2) = 1)
 SELECT b.*, top_actor1, top_actor2, CASE quad_class WHEN 1 THEN 'Verbal Cooperation' WHEN 2 THEN 'Material Cooperation' WHEN 3 THEN 'Verbal Conflict' ELSE 'Material Conflict' END AS label, {ROUND2('greatest(0, least(1, 0.5 - avg_goldstein / 10))')} AS intensity FROM b JOIN a1 USING (country_code, quad_class) JOIN a2 USING (country_code, quad_class)""")
def k27(t):
    return H.event_clusters(t.geo_events, AS_OF, 480)


CONFLICTS = "SELECT concat('C', CAST(event_id AS VARCHAR)) AS id, ts, actor1, actor2, country_code, latitude, longitude, CAST(num_mentions AS BIGINT) AS fatalities, 'verified' AS severity, CAST(0 AS BIGINT) AS mentions FROM geo_events WHERE quad_class = 4 AND root_code = '03'"


def _conflicts(t):
    return t.geo_events.where("quad_class = 4 and root_code = '03'").select(F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("id"), "ts", "actor1", "actor2", "country_code", "latitude", "longitude", F.col("num_mentions").cast("long").alias("fatalities"))


@query("b15_conflict_markers", f", c AS ({CONFLICTS}) SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM (SELECT * FROM c WHERE {NOW(480)} ORDER BY ts DESC, mentions DESC, id LIMIT 200)")
def b15(t):
    return H.conflict_markers(_conflicts(t), t.geo_events, AS_OF, days=20).withColumn("ts", F.col("ts").cast("string"))


@query("b15_conflict_fallback", f"SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM (SELECT CAST(event_id AS VARCHAR) AS id, ts, actor1, actor2, country_code, latitude, longitude, CAST(0 AS BIGINT) AS fatalities, 'inferred' AS severity, CAST(num_mentions AS BIGINT) AS mentions FROM geo_events WHERE {NOW(480)} AND quad_class = 4 AND goldstein < -3 ORDER BY ts DESC, num_mentions DESC, id LIMIT 200)")
def b15f(t):
    """No verified conflict: events stand in."""
    return H.conflict_markers(_conflicts(t).where("id = ''"), t.geo_events, AS_OF, days=20).withColumn("ts", F.col("ts").cast("string"))


@query("b16_list_conflicts", f", c AS ({CONFLICTS}) SELECT id, fatalities FROM c WHERE contains(lower(country_code), 'n1') ORDER BY ts DESC, id LIMIT 100")
def b16(t):
    return H.list_conflicts(_conflicts(t), "N1").select("id", "fatalities")


@query("b17_list_events", f"SELECT event_id, quad_class FROM geo_events WHERE {NOW(240)} AND country_code = 'N05' ORDER BY ts DESC, event_id LIMIT 100")
def b17(t):
    return H.list_events(t.geo_events, AS_OF, 240, "N05").select("event_id", "quad_class")


@query("k24_trending_country", "SELECT keyword, min(rank) AS rank, max(volume) AS volume FROM trends WHERE country_code = 'N02' GROUP BY ALL ORDER BY rank, keyword LIMIT 20")
def k24(t):
    return H.trending_searches(t.trends, "N02")


@query("k24_trending_global", "SELECT keyword, count(DISTINCT country_code) AS countries, min(rank) AS best_rank FROM trends GROUP BY ALL ORDER BY countries DESC, best_rank, keyword LIMIT 20")
def k24g(t):
    return H.trending_searches(t.trends)


WORDS = ", w AS (SELECT DISTINCT lower(unnest(string_split(headline, ' '))) AS word FROM signals), ww AS (SELECT word FROM w WHERE length(word) > 3)"


def _words(t):
    return t.signals.select(F.explode(F.split(F.lower("headline"), " ")).alias("word")).where(F.length("word") > 3).distinct()


@query("k25_trend_match", WORDS + ", f AS (SELECT lower(keyword) AS t, CAST(sum(volume) AS BIGINT) AS total FROM trends GROUP BY ALL) SELECT t, total, string_agg(word, ',' ORDER BY word) AS words FROM f JOIN ww ON contains(t, word) GROUP BY ALL")
def k25(t):
    return H.text_match(_words(t), t.trends, "keyword", "volume")


@query("k25_page_match", WORDS + ", f AS (SELECT lower(title) AS t, CAST(sum(views) AS BIGINT) AS total FROM pageviews GROUP BY ALL) SELECT t, total, string_agg(word, ',' ORDER BY word) AS words FROM f JOIN ww ON contains(t, word) GROUP BY ALL")
def k25p(t):
    return H.text_match(_words(t), t.pageviews, "title", "views")


@query("k26_top_pages", ", p AS (SELECT title, CAST(sum(views) AS BIGINT) AS views FROM pageviews GROUP BY ALL) SELECT title, views, CAST(row_number() OVER (ORDER BY views DESC, title) AS INTEGER) AS rank FROM p QUALIFY rank <= 25")
def k26(t):
    return H.top_pages(t.pageviews)


@query("b5_crisis_signals", "SELECT signal_id, severity FROM signals WHERE is_crisis AND event_type = 'click' ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, ts DESC, signal_id LIMIT 100")
def b5(t):
    return H.crisis_signals(t.signals, event_type="click").select("signal_id", "severity")


@query("k28_crisis_totals", f"SELECT count(*) AS signals, count(*) FILTER (WHERE is_crisis) AS crises, count(DISTINCT country_code) FILTER (WHERE is_crisis) AS countries FROM signals WHERE {NOW(240)}")
def k28(t):
    return H.crisis_summary(t.signals, AS_OF, 240)["totals"]


@query("k28_crisis_countries", f"SELECT country_code, count(*) AS n, round(avg(crisis_score), 6) AS score FROM signals WHERE {NOW(240)} AND is_crisis GROUP BY ALL ORDER BY n DESC, country_code LIMIT 10")
def k28c(t):
    return H.crisis_summary(t.signals, AS_OF, 240)["countries"]


@query("k29_signal_velocity", f"SELECT count(*) FILTER (WHERE {NOW(48)}) AS last, count(*) FILTER (WHERE {BASE(96, 48)}) AS previous, last - previous AS change FROM signals")
def k29(t):
    return H.signal_velocity(t.signals, AS_OF, 48 * 60)


@query("d14_points_in_boxes", ", b AS (SELECT country_code AS id, latitude - 3 AS lat_min, latitude + 0.3 AS lat_max, longitude - 2 AS lon_min, longitude + 0.1 AS lon_max FROM countries) SELECT id, count(*) AS n FROM signals JOIN b ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max GROUP BY ALL")
def d14(t):
    c = lambda x, d: F.col(x) + F.lit(float(d))
    boxes = t.countries.select(F.col("country_code").alias("id"), c("latitude", -3).alias("lat_min"), c("latitude", 0.3).alias("lat_max"), c("longitude", -2).alias("lon_min"), c("longitude", 0.1).alias("lon_max"))
    return H.in_boxes(t.signals.select("signal_id", "latitude", "longitude"), boxes).groupBy("id").agg(F.count("*").alias("n"))


_KM = "6371 * 2 * atan2(sqrt(a), sqrt(1 - a))"


@query("d15_chokepoint_counts", ", q AS (SELECT unnest([" + ", ".join(f"{{'i': {i}, 'id': '{n}', 'la': {a}::DOUBLE, 'lo': {o}::DOUBLE, 'km': {k * 4}::DOUBLE}}" for i, (n, a, o, k) in enumerate(dims.CHOKEPOINTS)) + f"], recursive := true)), d AS (SELECT signal_id, i, id, km, pow(sin(radians(la - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(la)) * pow(sin(radians(lo - longitude) / 2), 2) AS a FROM signals, q), f AS (SELECT signal_id, arg_min(id, i) AS chokepoint FROM d WHERE {_KM} < km GROUP BY ALL) SELECT chokepoint, count(*) AS n FROM f GROUP BY ALL")
def d15(t):
    wide = [(n, a, o, k * 4) for n, a, o, k in dims.CHOKEPOINTS]
    return H.nearest_chokepoint(t.signals, wide).where("chokepoint is not null").groupBy("chokepoint").agg(F.count("*").alias("n"))


@query("m9_aircraft_snapshot", "SELECT icao24, kind, altitude FROM (SELECT 'a' || printf('%05d', signal_id) AS icao24, CASE WHEN signal_id % 5 = 0 THEN 'military' WHEN signal_id % 5 = 1 THEN 'government' WHEN signal_id % 5 = 2 THEN 'commercial' ELSE 'private' END AS kind, (sentiment + 5) * 1200 AS altitude, is_crisis AS on_ground, latitude, longitude FROM signals) WHERE NOT on_ground AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 ORDER BY altitude DESC, icao24 LIMIT 500")
def m9(t):
    k = F.col("signal_id") % 5
    callsign = F.when(k == 0, "RCH12").when(k == 1, "GOV9").when(k == 2, "DLH44").otherwise("N-1")
    flying = t.signals.select(F.concat(F.lit("a"), F.format_string("%05d", "signal_id")).alias("icao24"), callsign.alias("callsign"), ((F.col("sentiment") + 5) * 1200).alias("altitude"), F.col("is_crisis").alias("on_ground"), "latitude", "longitude")
    return H.aircraft_snapshot(flying, ["RCH"], ["GOV"], ["ae"], 500).select("icao24", "kind", "altitude")


@query("c22_region_and_class", "SELECT signal_id, CASE WHEN attribution_method = 'reddit_public' OR source_family = 'social' THEN 'social_commentary' WHEN attribution_method = 'reliefweb_ocha' OR source_family = 'ngo' THEN 'humanitarian' WHEN is_state_media OR source_family = 'state' THEN 'state_media' WHEN source_family = 'wire' THEN 'wire' WHEN source_family IN ('gdelt', 'rss', 'api', 'independent') THEN 'reporting' ELSE 'unknown' END AS signal_class FROM signals")
def c26(t):
    return t.signals.select("signal_id", exprs.signal_class(F.col("source_family"), F.col("attribution_method"), F.col("is_state_media")).alias("signal_class"))
