"""Queries: heat, anomalies, indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import heat as H
from ..operators import rollups as R
from .fixture import AS_OF
from .registry import query

ALLOWED = [f"src{i}.example.com" for i in range(0, 20, 3)]
DENIED = [f"src{i}.example.com" for i in range(1, 20, 7)]
LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
NOW = lambda h: f"ts > {{AS_OF}} - INTERVAL {h} HOURS AND ts <= {{AS_OF}}"
BASE = lambda h, s: f"ts > {{AS_OF}} - INTERVAL {h} HOURS AND ts <= {{AS_OF}} - INTERVAL {s} HOURS"
ROUND2 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(24, 8)), 2) AS DOUBLE)"
LEVEL = "CASE WHEN multiplier IS NULL OR zscore IS NULL THEN 'normal' WHEN zscore > 4 AND multiplier > 3 THEN 'critical' WHEN zscore > 2.5 OR multiplier > 2 THEN 'elevated' WHEN zscore > 1.5 AND multiplier > 1.5 THEN 'notable' ELSE 'normal' END"


HEAT = f""", w AS (SELECT * FROM signals WHERE {NOW(72)}),
 a AS (SELECT country_code, count(*) AS volume_now, avg(nullif(geo_confidence, 0)) AS geo, count(source_origin_country) AS known,
   count(*) FILTER (WHERE source_origin_country = country_code) / nullif(count(source_origin_country), 0) AS loc, 1 - count(DISTINCT lower(headline)) / nullif(count(headline), 0) AS dup FROM w GROUP BY ALL),
 d AS (SELECT country_code, date_trunc('day', ts) AS day, count(*) AS n FROM signals WHERE {BASE(336, 24)} GROUP BY ALL), b AS (SELECT country_code, avg(n) AS base, nullif(stddev_pop(n), 0) AS sigma FROM d GROUP BY ALL),
 t AS (SELECT country_code, lower(unnest(themes)) AS theme FROM w), g AS (SELECT theme, count(*) AS gn FROM t GROUP BY ALL), c AS (SELECT country_code, theme, count(*) AS n FROM t GROUP BY ALL),
 p AS (SELECT country_code, n / sum(n) OVER (PARTITION BY country_code) AS p, gn / (SELECT sum(gn) FROM g) AS q FROM c JOIN g USING (theme)), kl AS (SELECT country_code, sum(p * ln(greatest(p / q, 1e-9))) AS kl FROM p GROUP BY ALL),
 f AS (SELECT country_code, source_family AS x, count(*) AS n FROM w GROUP BY ALL), fp AS (SELECT country_code, n / sum(n) OVER (PARTITION BY country_code) AS p FROM f), fe AS (SELECT country_code, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS fam FROM fp GROUP BY ALL),
 m AS (SELECT country_code, nlp_framing AS x, count(*) AS n FROM w WHERE nlp_framing IS NOT NULL GROUP BY ALL), mp AS (SELECT country_code, n, n / sum(n) OVER (PARTITION BY country_code) AS p FROM m), me AS (SELECT country_code, -sum(p * ln(p)) AS fh, sum(n) AS framed FROM mp GROUP BY ALL),
 j AS (SELECT a.country_code, volume_now, round(base, 6) AS baseline_daily, coalesce(1 / (1 + exp(-(volume_now / 3.0 - base) / sigma / 3)), 0.5) AS velocity, coalesce(least(greatest(kl, 0) / 2, 1), 0) AS surprise, coalesce(fam, 0) AS diversity,
   coalesce(CASE WHEN known >= 20 THEN loc END, 0.5) AS local_voice, coalesce(CASE WHEN framed >= 10 THEN fh / ln(6) END, 0.5) AS polyphony, coalesce(geo, 0.5) AS geo_confidence, coalesce(least(greatest(dup, 0), 1), 0) AS duplication
   FROM a LEFT JOIN b USING (country_code) LEFT JOIN kl USING (country_code) LEFT JOIN fe USING (country_code) LEFT JOIN me USING (country_code))"""


@query("k1_country_heat", HEAT + """
 SELECT country_code, volume_now, baseline_daily, round(velocity, 6) AS velocity, round(surprise, 6) AS surprise, round(diversity, 6) AS diversity, round(local_voice, 6) AS local_voice, round(polyphony, 6) AS polyphony, round(geo_confidence, 6) AS geo_confidence, round(duplication, 6) AS duplication,
   round(0.25 * velocity + 0.2 * surprise + 0.15 * diversity + 0.15 * local_voice + 0.1 * polyphony + 0.1 * geo_confidence - 0.05 * duplication, 6) AS heat FROM j""")
def k1(t):
    return H.country_heat(t.signals, AS_OF, hours=72, least_origins=20, least_framed=10)


ANOMALIES = f""", h AS (SELECT country_code, date_trunc('hour', ts) AS ts, count(*) AS n FROM signals GROUP BY ALL), cur AS (SELECT country_code, CAST(sum(n) AS BIGINT) AS current_count FROM h WHERE {NOW(72)} GROUP BY ALL HAVING sum(n) >= 5),
 d AS (SELECT country_code, date_trunc('day', ts) AS day, sum(n) AS n FROM h WHERE {BASE(336, 72)} GROUP BY ALL), b AS (SELECT country_code, count(*) AS days_observed, avg(n) AS mean, stddev_samp(n) AS sd FROM d GROUP BY ALL),
 z AS (SELECT country_code, name AS country_name, current_count, round(mean, 6) AS baseline_avg, days_observed, {ROUND2('current_count / nullif(mean * 3, 0)')} AS multiplier, {ROUND2('(current_count - mean * 3) / nullif(coalesce(sd, mean * 0.3) * 3, 0)')} AS zscore FROM cur JOIN b USING (country_code) LEFT JOIN countries USING (country_code)),
 lv AS (SELECT *, {LEVEL} AS level FROM z)"""


def _anomalies(t):
    return H.country_anomalies(R.country_hourly(t.signals), t.countries, AS_OF, hours=72, days=14)


@query("k2_country_anomalies", ANOMALIES + " SELECT * FROM lv")
def k2(t):
    return _anomalies(t)


@query("k2_near_misses", ANOMALIES + " SELECT * FROM (SELECT * FROM (SELECT * FROM lv ORDER BY zscore DESC NULLS LAST, country_code LIMIT 40) WHERE level = 'normal' AND multiplier > 1 ORDER BY zscore DESC NULLS LAST, country_code LIMIT 3)")
def k2m(t):
    return H.anomaly_lists(_anomalies(t), 20)["near_misses"]


@query("k2_system_totals", f", h AS (SELECT country_code, date_trunc('hour', ts) AS hour, count(*) AS n FROM signals GROUP BY ALL) SELECT count(DISTINCT country_code) AS active_countries, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_signals FROM h WHERE hour > {{AS_OF}} - INTERVAL 24 HOURS AND hour <= {{AS_OF}}")
def k2t(t):
    return H.system_totals(R.country_hourly(t.signals), AS_OF)


@query("k2_overall_severity", ANOMALIES + " SELECT CASE max(CASE level WHEN 'critical' THEN 3 WHEN 'elevated' THEN 2 WHEN 'notable' THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'elevated' WHEN 1 THEN 'notable' ELSE 'normal' END AS overall, count(*) FILTER (WHERE level <> 'normal') AS anomalies FROM lv")
def k2b(t):
    return H.overall_severity(_anomalies(t))


@query("k3_theme_anomalies", f""", t AS (SELECT ts, unnest(themes) AS theme FROM signals), cur AS (SELECT theme, count(*) AS current_count FROM t WHERE {NOW(30)} GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT theme, date_trunc('day', ts) AS day, count(*) AS n FROM t GROUP BY ALL),
 b AS (SELECT theme, avg(n) AS mean, stddev_samp(n) AS sd FROM d WHERE day > {{AS_OF}} - INTERVAL 20 DAYS GROUP BY ALL)
 SELECT theme, current_count, round(mean, 6) AS baseline_avg, {ROUND2('current_count / nullif(mean * 1.25, 0)')} AS multiplier, {ROUND2('(current_count - mean * 1.25) / nullif(coalesce(sd, mean * 0.3) * 1.25, 0)')} AS zscore FROM cur JOIN b USING (theme) WHERE (current_count - mean * 1.25) / nullif(coalesce(sd, mean * 0.3) * 1.25, 0) > -1.5""")
def k3(t):
    return H.theme_anomalies(t.signals, R.theme_daily(t.signals), AS_OF, hours=30, least=3, days=20, z_min=-1.5)


BASELINE = f", d AS (SELECT country_code, date_trunc('day', ts) AS day, count(*) AS n FROM signals WHERE {NOW(168)} GROUP BY ALL), b AS (SELECT country_code, count(*) AS days, round(avg(n), 6) AS avg_daily, round(coalesce(nullif(stddev_samp(n), 0), 0.3 * avg(n)), 6) AS sd_daily FROM d GROUP BY ALL)"


@query("k4_country_baseline", BASELINE + " SELECT * FROM b")
def k4(t):
    return H.country_baseline(t.signals, AS_OF)


#: Rows, tone and outlets by country from a rollup of means, or from the rows with a focus.
NODES = f""", hr AS (SELECT country_code, date_trunc('hour', ts) AS slot, count(*) AS n, round(avg(sentiment), 6) AS tone, count(DISTINCT source_name) AS sources FROM signals GROUP BY ALL),
 dy AS (SELECT country_code, date_trunc('day', ts) AS slot, count(*) AS n, round(avg(sentiment), 6) AS tone, count(DISTINCT source_name) AS sources FROM signals GROUP BY ALL)"""
NODE = lambda hours, told: f"""SELECT country_code, coalesce(name, country_code) AS name, latitude, longitude, CAST(n AS BIGINT) AS signal_count, round(tone / 10, 6) AS tone, CAST(sources AS BIGINT) AS sources, round(n / max(n) OVER (), 6) AS intensity,
 round(CASE WHEN {told} AND avg_daily IS NOT NULL THEN greatest(0, least(1, (n - avg_daily * {hours} / 24) / (sd_daily * {hours} / 24) / 3)) ELSE n / max(n) OVER () END, 6) AS heat,
 CASE WHEN {told} AND avg_daily IS NOT NULL THEN {LEVEL.replace("multiplier", f"(n / (avg_daily * {hours} / 24))").replace("zscore", f"((n - avg_daily * {hours} / 24) / (sd_daily * {hours} / 24))")} ELSE 'normal' END AS level FROM w LEFT JOIN countries USING (country_code) LEFT JOIN b USING (country_code)"""  # noqa: E731
BASELINE_B = BASELINE.removeprefix(", ").replace("d AS (", "bd AS (", 1).replace("FROM d GROUP", "FROM bd GROUP")


def _nodes(t, **how):
    return H.country_nodes(t.signals, R.country_hourly(t.signals), R.country_daily(t.signals), t.countries, H.country_baseline(t.signals, AS_OF), AS_OF, **how)


@query("k5_country_nodes", NODES + f", {BASELINE_B}, w AS (SELECT country_code, sum(n) AS n, avg(tone) AS tone, sum(sources) AS sources FROM hr WHERE slot > {{AS_OF}} - INTERVAL 48 HOURS AND slot <= {{AS_OF}} GROUP BY ALL) " + NODE(48, "true"))
def k5(t):
    return _nodes(t, hours=48)


@query("k5_country_nodes_month", NODES + f", {BASELINE_B}, w AS (SELECT country_code, sum(n) AS n, avg(tone) AS tone, sum(sources) AS sources FROM dy WHERE slot > {{AS_OF}} - INTERVAL 30 DAYS AND slot <= {{AS_OF}} GROUP BY ALL ORDER BY n DESC, country_code LIMIT 12) " + NODE(720, "true"))
def k5m(t):
    """A month, from the daily rollup; the twelve largest countries."""
    return _nodes(t, range_name="1m", limit=12)


@query("k5_country_nodes_focus", f", {BASELINE_B}, w AS (SELECT country_code, count(*) AS n, avg(sentiment) AS tone, count(DISTINCT source_name) AS sources FROM signals WHERE {NOW(168)} AND list_contains(themes, 'CLICK') GROUP BY ALL), w2 AS (SELECT * FROM w WHERE country_code IN ('N01', 'N05', 'N07', 'N19')) " + NODE(168, "false").replace("FROM w ", "FROM w2 w "))
def k5f(t):
    """The rows about one theme in four countries; heat is the share of the largest."""
    return _nodes(t, range_name="3m", focus=("theme", "click"), only=["n01", "N05", "N07 ", "N19"])


DIVERSITY = ", c AS (SELECT country_code, source_name, count(*) AS n FROM src GROUP BY ALL), p AS (SELECT country_code, n / sum(n) OVER (PARTITION BY country_code) AS p FROM c), dv AS (SELECT country_code, count(*) AS outlets, round(least(50, 50 * ln(count(*) + 1) / ln(21)) + 50 * CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS diversity FROM p GROUP BY ALL)"
QUALITY = f", q AS (SELECT DISTINCT country_code, source_name AS d FROM src), ql AS (SELECT country_code, count(*) AS domains, CAST(greatest(0, least(100, 30 + least(70, 10 * count(*) FILTER (WHERE d IN {LIST(ALLOWED)})) - 20 * count(*) FILTER (WHERE d IN {LIST(DENIED)}))) AS INTEGER) AS quality FROM q GROUP BY ALL)"
VOLUME = f", nw AS (SELECT country_code, count(*) AS current FROM signals WHERE {NOW(72)} GROUP BY ALL), vd AS (SELECT country_code, date_trunc('day', ts) AS day, count(*) AS n FROM signals WHERE {BASE(240, 72)} GROUP BY ALL), vb AS (SELECT country_code, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS sd FROM vd GROUP BY ALL), vl AS (SELECT country_code, current, mean, current / 3.0 / mean AS m, CASE WHEN sd > 0 THEN (current / 3.0 - mean) / sd WHEN current / 3.0 > mean THEN 3 WHEN current / 3.0 < mean THEN -3 WHEN current / 3.0 = mean THEN 0 END AS x FROM nw LEFT JOIN vb USING (country_code)), v AS (SELECT country_code, current, CAST(round(CAST(mean AS DECIMAL(24, 8)), 1) AS DOUBLE) AS baseline, {ROUND2('m')} AS multiplier, {ROUND2('x')} AS z, CASE WHEN x IS NULL THEN 'unknown' WHEN x > 3 THEN 'exceptional' WHEN x > 2 THEN 'high' WHEN x > 1 THEN 'elevated' WHEN x < -1 THEN 'low' ELSE 'normal' END AS level FROM vl)"


@query("k30_source_diversity", ", src AS (SELECT * FROM signals)" + DIVERSITY + " SELECT * FROM dv")
def k30(t):
    return H.source_diversity(t.signals, "country_code")


@query("k31_source_quality", ", src AS (SELECT * FROM signals)" + QUALITY + " SELECT * FROM ql")
def k31(t):
    return H.source_quality(t.signals, "country_code", ALLOWED, DENIED)


@query("k32_normalized_volume", VOLUME + " SELECT * FROM v")
def k32(t):
    return H.normalized_volume(t.signals, "country_code", AS_OF, 72)


@query("k33_country_indicators", f", src AS (SELECT * FROM signals WHERE {NOW(72)})" + DIVERSITY + QUALITY + VOLUME + " SELECT country_code, outlets, diversity, domains, quality, current, baseline, multiplier, z, level FROM dv JOIN ql USING (country_code) JOIN v USING (country_code)")
def k33(t):
    return H.country_indicators(t.signals, AS_OF, 72, ALLOWED, DENIED)


@query("c40_heat_flags", HEAT + """, hh AS (SELECT country_code, volume_now AS n, round(diversity, 6) AS dv, round(local_voice, 6) AS lv, round(polyphony, 6) AS po, round(geo_confidence, 6) AS ge FROM j)
 SELECT country_code, concat_ws(',', CASE WHEN lv > 0 AND lv < 0.2 THEN 'external_coverage' END, CASE WHEN dv < 0.3 THEN 'wire_dominance' END, CASE WHEN n < 50 AND ge > 0 AND ge < 0.7 THEN 'thin_coverage' END, CASE WHEN n > 100 AND po > 0 AND po < 0.3 THEN 'echo_chamber' END) AS flags FROM hh""")
def c40(t):
    """Warnings from the parts of each country's heat."""
    c = F.col
    return k1(t).select("country_code", F.array_join(exprs.heat_flags(c("local_voice"), c("diversity"), c("volume_now"), c("geo_confidence"), c("polyphony")), ",").alias("flags"))
