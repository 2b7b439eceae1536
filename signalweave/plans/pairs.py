"""Queries: pairs, correlations, flows, graphs, grids, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import pairs as P
from ..operators import rollups as R
from .aggregates import EXPLODED, HOUR, MENTIONS
from .fixture import AS_OF
from .heat import NOW, ROUND2
from .registry import query
from .themes import TOP3


K6 = f""", t AS (SELECT country_code, unnest(themes) AS theme FROM signals WHERE {NOW(240)}), c AS (SELECT country_code, theme, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2), tot AS (SELECT country_code, sum(n) AS total FROM c GROUP BY ALL HAVING sum(n) >= 5),
 s AS (SELECT country_code, theme FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, theme) AS rk FROM c) WHERE rk <= 12 AND country_code IN (SELECT country_code FROM tot)), z AS (SELECT country_code, count(*) AS k FROM s GROUP BY ALL),
 p AS (SELECT x.country_code AS a, y.country_code AS b, count(*) AS shared, array_to_string(list_slice(list_sort(list(theme)), 1, 5), ',') AS themes FROM s x JOIN s y USING (theme) WHERE x.country_code < y.country_code GROUP BY ALL),
 j AS (SELECT a, b, shared, themes, shared / (za.k + zb.k - shared) AS jac, least(ta.total, tb.total) AS low FROM p JOIN z za ON a = za.country_code JOIN z zb ON b = zb.country_code JOIN tot ta ON a = ta.country_code JOIN tot tb ON b = tb.country_code)
 SELECT a, b, {ROUND2('jac * low / 10')} AS strength, round(jac, 3) AS similarity, shared, themes FROM j WHERE jac >= 0.2 AND shared >= 3 ORDER BY strength DESC, a, b LIMIT 100"""


@query("k6_theme_flows", K6)
def k6(t):
    return P.theme_flows(t.signals, AS_OF, 240, top=12)


@query("k6_flows_in_focus", K6.replace(NOW(240), NOW(400) + " AND list_contains(themes, 'CLICK') AND country_code NOT IN ('N03', 'N04')").replace("sum(n) >= 5", "sum(n) >= 3").replace("\n SELECT a, b,", "\n SELECT a, b, ca.latitude AS lat_a, ca.longitude AS lon_a, cb.latitude AS lat_b, cb.longitude AS lon_b,").replace("FROM j WHERE", "FROM j JOIN countries ca ON a = ca.country_code JOIN countries cb ON b = cb.country_code WHERE"))
def k6f(t):
    """Flows of the rows about one theme, between countries that have a place."""
    placed = t.countries.withColumn("latitude", F.when(~F.col("country_code").isin("N03", "N04"), F.col("latitude")))
    return P.theme_flows(t.signals, AS_OF, 400, top=12, focus=("theme", "click"), countries=placed)


@query("k7_theme_correlation", EXPLODED + ", top AS (SELECT theme, count(*) AS n FROM t GROUP BY ALL ORDER BY n DESC, theme LIMIT 10), f AS (SELECT signal_id, theme FROM t SEMI JOIN top USING (theme)), b AS (SELECT x.theme AS a, y.theme AS b, count(*) AS shared FROM f x JOIN f y USING (signal_id) WHERE x.theme < y.theme GROUP BY ALL), e AS (SELECT x.theme AS a, y.theme AS b, x.n AS na, y.n AS nb FROM top x JOIN top y ON x.theme < y.theme) SELECT a, b, round(coalesce(shared, 0) / (na + nb - coalesce(shared, 0)), 3) AS jaccard FROM e LEFT JOIN b USING (a, b)")
def k7(t):
    return P.theme_correlation(t.signals)


@query("k8_country_correlation", f", w AS (SELECT * FROM signals WHERE {NOW(24)}), top AS (SELECT country_code, count(*) AS n FROM w GROUP BY ALL ORDER BY n DESC, country_code LIMIT 12), s AS (SELECT DISTINCT country_code, unnest(themes) AS theme FROM w SEMI JOIN top USING (country_code)), z AS (SELECT country_code, count(*) AS k FROM s GROUP BY ALL), p AS (SELECT x.country_code AS a, y.country_code AS b, count(*) AS shared FROM s x JOIN s y USING (theme) WHERE x.country_code < y.country_code GROUP BY ALL) SELECT a, b, round(shared / (za.k + zb.k - shared), 3) AS jaccard FROM p JOIN z za ON a = za.country_code JOIN z zb ON b = zb.country_code")
def k8(t):
    return P.country_correlation(t.signals.where(exprs.in_window(F.col("ts"), AS_OF, 24)), 12)


def _topics(t):
    """Each country's themes of a day as topics, all at the country's first row."""
    rows = t.signals.where(exprs.in_window(F.col("ts"), AS_OF, 72))
    first = rows.groupBy("country_code").agg(F.min("ts").alias("ts"))
    labels = rows.select("country_code", F.lower("headline").alias("label")).distinct()
    return labels.join(first, "country_code").withColumn("topic_id", F.concat_ws("/", "country_code", "label"))


TERMS = f""", rw AS (SELECT * FROM signals WHERE {NOW(72)}), fs AS (SELECT country_code, min(ts) AS ts FROM rw GROUP BY ALL), tp AS (SELECT DISTINCT country_code, lower(headline) AS label FROM rw), tk AS (SELECT country_code || '/' || label AS topic_id, list_filter(regexp_extract_all(label, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'in', 'is', 'it', 'of', 'on', 'that', 'the', 'to', 'was', 'with')) AS ws FROM tp),
 tm AS (SELECT topic_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM tk), tf AS (SELECT topic_id, term, count(*) AS tf FROM tm GROUP BY ALL)"""
FLOWS = TERMS + """, df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 w0 AS (SELECT topic_id, term, tf * (ln((1 + (SELECT count(*) FROM tp)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), vv AS (SELECT topic_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic_id)) AS w, split_part(topic_id, '/', 1) AS cc FROM w0),
 d AS (SELECT x.topic_id AS ta, y.topic_id AS tb, x.cc AS a, y.cc AS b, fa.ts AS tsa, fb.ts AS tsb, sum(x.w * y.w) AS cosine FROM vv x JOIN vv y USING (term) JOIN fs fa ON x.cc = fa.country_code JOIN fs fb ON y.cc = fb.country_code WHERE x.cc <> y.cc AND (fa.ts < fb.ts OR (fa.ts = fb.ts AND x.cc < y.cc)) GROUP BY ALL),
 pr AS (SELECT a, b, max(cosine) AS similarity, (epoch(min(tsb)) - epoch(min(tsa))) / 3600 AS h, array_to_string(list_slice(list_sort(list(DISTINCT split_part(ta, '/', 2)) FILTER (WHERE cosine >= 0.05)), 1, 3), ',') AS topics FROM d GROUP BY ALL),
 fl AS (SELECT a AS source, b AS target, round(similarity, 6) AS similarity, round(similarity * exp(-h / 6), 6) AS heat, coalesce(topics, '') AS topics FROM pr WHERE h <= 48)"""


@query("k9_topic_flows", FLOWS + " SELECT * FROM fl WHERE heat >= 0.05")
def k9(t):
    return P.topic_flows(_topics(t), threshold=0.05, window_hours=48)


PAIR_FLOWS = TERMS + """, c AS (SELECT *, split_part(topic_id, '/', 1) AS cc FROM tf), nc AS (SELECT country_code AS cc, count(*) AS n FROM tp GROUP BY ALL), cd AS (SELECT cc, term, count(*) AS d FROM c GROUP BY ALL),
 pc AS (SELECT x.country_code AS a, y.country_code AS b, x.ts AS tsa, y.ts AS tsb, na.n + nb.n AS n FROM fs x JOIN fs y ON x.ts < y.ts OR (x.ts = y.ts AND x.country_code < y.country_code) JOIN nc na ON na.cc = x.country_code JOIN nc nb ON nb.cc = y.country_code WHERE epoch(y.ts) - epoch(x.ts) <= 48 * 3600),
 w AS (SELECT a, b, c.cc, topic_id, c.term, tf * (ln((1 + pc.n) / (1 + coalesce(da.d, 0) + coalesce(db.d, 0))) + 1) AS w FROM pc JOIN c ON c.cc IN (a, b) LEFT JOIN cd da ON da.cc = a AND da.term = c.term LEFT JOIN cd db ON db.cc = b AND db.term = c.term),
 u AS (SELECT * REPLACE (w / sqrt(sum(w * w) OVER (PARTITION BY a, b, topic_id)) AS w) FROM w), cs AS (SELECT x.a, x.b, x.topic_id AS ta, sum(x.w * y.w) AS score FROM u x JOIN u y ON x.a = y.a AND x.b = y.b AND x.term = y.term AND x.cc = x.a AND y.cc = y.b GROUP BY x.a, x.b, x.topic_id, y.topic_id),
 st AS (SELECT country_code AS cc, country_code || '/' || label AS topic_id, list_distinct(list_filter(list_transform(string_split_regex(trim(label), '\\s+'), lambda x: CASE WHEN ends_with(x, 'ing') AND length(x) > 5 THEN x[:-4] WHEN ends_with(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END), lambda x: length(x) > 2)) AS ws FROM tp),
 ov AS (SELECT a, b, x.topic_id AS ta, len(list_intersect(x.ws, y.ws)) / least(len(x.ws), len(y.ws)) AS score FROM pc JOIN st x ON x.cc = a JOIN st y ON y.cc = b WHERE len(x.ws) > 0 AND len(y.ws) > 0),
 al AS (SELECT * FROM cs UNION ALL SELECT * FROM ov), g AS (SELECT a, b, least(1, max(score)) AS s, array_to_string(list_slice(list_sort(list(DISTINCT split_part(ta, '/', 2)) FILTER (WHERE score >= 0.2)), 1, 3), ',') AS topics FROM al GROUP BY ALL), h AS (SELECT g.*, round(s * exp(-(epoch(tsb) - epoch(tsa)) / 3600 / 6), 6) AS heat FROM g JOIN pc USING (a, b))
 SELECT a AS source, b AS target, round(s, 6) AS similarity, heat, topics FROM h WHERE heat >= 0.2"""


@query("k9_pair_flows", PAIR_FLOWS)
def k9p(t):
    return P.pair_flows(_topics(t), threshold=0.2, window_hours=48)


@query("k46_active_flows", FLOWS + " SELECT source, x.name AS source_name, target, y.name AS target_name, heat FROM fl LEFT JOIN countries x ON source = x.country_code LEFT JOIN countries y ON target = y.country_code WHERE heat >= 0.1")
def k46(t):
    return P.active_flows(P.topic_flows(_topics(t), threshold=0.05, window_hours=48), t.countries, 0.1)


@query("k10_hotspots", f""", t AS (SELECT country_code, unnest(themes) AS theme, signal_id % 7 AS m, geo_confidence FROM signals), rw AS (SELECT country_code, theme, sum(m) AS count, avg(geo_confidence) AS conf FROM t GROUP BY ALL), b AS (SELECT country_code, count(*) AS topics, avg(count) AS ac, avg(conf) AS cf FROM rw GROUP BY ALL),
 l AS (SELECT country_code, CASE WHEN sentiment < -10 THEN 'very_negative' WHEN sentiment < -2 THEN 'negative' WHEN sentiment <= 2 THEN 'neutral' WHEN sentiment <= 10 THEN 'positive' ELSE 'very_positive' END AS label, count(*) AS k FROM signals GROUP BY ALL), dm AS (SELECT country_code, label AS dominant FROM l QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY k DESC, label) = 1),
 o AS (SELECT country_code, round(count(DISTINCT source_name) / count(*), 6) AS diversity FROM signals GROUP BY ALL), tt AS (SELECT country_code, string_agg(theme, ',' ORDER BY rk) AS top_topics FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY count DESC, theme) AS rk FROM rw) WHERE rk <= 5 GROUP BY ALL)
 SELECT country_code, topics, round(0.4 * least(topics / 100, 1) + 0.3 * least(ac / 1000, 1) + 0.3 * cf, 6) AS intensity, dominant, diversity, top_topics FROM b JOIN dm USING (country_code) JOIN o USING (country_code) JOIN tt USING (country_code)""")
def k10(t):
    return P.hotspots(t.signals, F.col("signal_id") % 7)


@query("k10_hotspots_by_signals", "SELECT country_code, round(avg(crisis_score), 6) AS intensity FROM signals GROUP BY ALL")
def k10s(t):
    return P.hotspots(t.signals, F.col("signal_id") % 7, F.col("crisis_score")).select("country_code", "intensity")


GRAPH = """, g AS (SELECT *, date_trunc('hour', ts) AS hour FROM signals WHERE list_contains(themes, 'K1')), kc AS (SELECT hour, country_code FROM g GROUP BY hour, country_code QUALIFY row_number() OVER (PARTITION BY hour ORDER BY count(*) DESC, country_code) <= 2), ks AS (SELECT hour, source_name FROM g GROUP BY hour, source_name QUALIFY row_number() OVER (PARTITION BY hour ORDER BY count(*) DESC, source_name) <= 2),
 pl AS (SELECT g.* FROM g SEMI JOIN kc USING (hour, country_code)), sr AS (SELECT pl.* FROM pl SEMI JOIN ks USING (hour, source_name)), pe AS (SELECT hour, country_code, sentiment, unnest(list_slice(persons, 1, 1)) AS person FROM pl), ot AS (SELECT hour, sentiment, unnest(list_slice(list_filter(themes, lambda x: x <> 'K1'), 1, 1)) AS other FROM g),
 fl AS (SELECT hour, 'country-' || country_code AS source, 'theme-K1' AS target, 'country-theme' AS kind, 'country-' || country_code AS node, sentiment FROM pl UNION ALL SELECT hour, 'source-' || source_name, 'country-' || country_code, 'source-country', 'source-' || source_name, sentiment FROM sr
   UNION ALL SELECT hour, 'person-' || person, 'country-' || country_code, 'person-country', 'person-' || person, sentiment FROM pe UNION ALL SELECT hour, 'theme-K1', 'theme-' || other, 'related-theme', 'theme-' || other, sentiment FROM ot),
 nd AS (SELECT hour, node AS id, split_part(node, '-', 1) AS type, count(*) AS n, round(avg(sentiment), 6) AS sentiment FROM fl GROUP BY ALL), kp AS (SELECT * FROM nd QUALIFY row_number() OVER (PARTITION BY hour, type ORDER BY n DESC, id) <= CASE type WHEN 'theme' THEN 1 WHEN 'country' THEN 2 WHEN 'source' THEN 2 ELSE 2 END)"""


def _graph(t):
    return P.temporal_graph(t.signals, "K1", countries=2, related=1, people=1, sources=2)


@query("k40_graph_nodes", GRAPH + " SELECT * REPLACE (CAST(hour AS VARCHAR) AS hour) FROM kp")
def k40n(t):
    return HOUR(_graph(t)["nodes"])


@query("k40_graph_links", GRAPH + ", ids AS (SELECT hour, id FROM kp UNION SELECT hour, 'theme-K1' FROM kp), lk AS (SELECT hour, source, target, kind, count(*) AS n FROM fl GROUP BY ALL) SELECT CAST(lk.hour AS VARCHAR) AS hour, source, target, kind, n FROM lk WHERE EXISTS (SELECT 1 FROM ids i WHERE i.hour = lk.hour AND i.id = source) AND EXISTS (SELECT 1 FROM ids i WHERE i.hour = lk.hour AND i.id = target)")
def k40l(t):
    return HOUR(_graph(t)["links"])


@query("k41_entity_graph", ", th AS (SELECT signal_id, 'theme' AS kind, unnest(themes) AS value FROM signals UNION ALL SELECT signal_id, 'person', unnest(persons) FROM signals UNION ALL SELECT signal_id, 'source', source_name FROM signals UNION ALL SELECT signal_id, 'country', country_code FROM signals), pin AS (SELECT * FROM th WHERE (kind = 'country' AND value IN ('N01', 'N02', 'N03')) OR (kind = 'theme' AND value LIKE 'K%')), ct AS (SELECT p.kind AS ka, p.value AS a, h.kind AS kb, h.value AS b, count(*) AS weight FROM pin p JOIN th h USING (signal_id) WHERE NOT (p.kind = h.kind AND p.value = h.value) GROUP BY ALL), tp AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY ka, a, kb ORDER BY weight DESC, b) <= 8) SELECT least(ka || '-' || a, kb || '-' || b) AS source, greatest(ka || '-' || a, kb || '-' || b) AS target, max(weight) AS weight FROM tp GROUP BY ALL")
def k41(t):
    pins = t.countries.where("country_code in ('N01', 'N02', 'N03')").select(F.lit("country").alias("kind"), F.col("country_code").alias("value"))
    themes = R.exploded(t.signals).where("theme like 'K%'").select(F.lit("theme").alias("kind"), F.col("theme").alias("value"))
    return P.entity_graph(t.signals, pins.unionByName(themes))


@query("k42_geo_pattern", EXPLODED + ", n AS (SELECT theme, t.country_code, region, count(*) AS n FROM t LEFT JOIN countries USING (country_code) GROUP BY ALL), tot AS (SELECT theme, sum(n) AS total, count(DISTINCT country_code) AS countries FROM n GROUP BY ALL), p AS (SELECT theme, region, sum(n) AS k FROM n GROUP BY ALL), q AS (SELECT p.*, countries, round(100.0 * k / total) AS pct, row_number() OVER (PARTITION BY theme ORDER BY k DESC, region) AS rk FROM p JOIN tot USING (theme)), w AS (SELECT theme, countries, count(*) AS nr, max(CASE WHEN rk = 1 THEN region END) AS first, max(CASE WHEN rk = 1 THEN pct END) AS p1, max(CASE WHEN rk = 2 THEN region END) AS second, coalesce(max(CASE WHEN rk = 2 THEN pct END), 0) AS p2 FROM q GROUP BY ALL) SELECT theme, countries, first, p1, second, p2, CASE WHEN countries < 3 THEN 'too_few' WHEN p1 >= 65 THEN 'concentrated' WHEN p2 >= 15 AND p1 + p2 >= 70 THEN 'two_regions' WHEN p2 >= 15 THEN 'led_by_two' WHEN nr >= 4 AND p1 < 40 THEN 'global' ELSE 'strongest' END AS pattern FROM w")
def k42(t):
    counts = R.exploded(t.signals).groupBy("theme", "country_code").agg(F.count("*").alias("n"))
    return P.geo_pattern(counts, t.countries.select("country_code", "region"))


@query("k43_v1_nodes", MENTIONS + f", b AS (SELECT country_code, CAST(sum(events) AS BIGINT) AS events, avg(avg_tone) AS tone FROM h GROUP BY ALL), e AS (SELECT country_code, theme, sum(events) AS k FROM h GROUP BY ALL), tt AS (SELECT country_code, string_agg(theme, ',' ORDER BY rk) AS themes FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY k DESC, theme) AS rk FROM e) WHERE rk <= 3 GROUP BY ALL) SELECT country_code, events, round(events / max(events) OVER (), 6) AS intensity, CAST(round(CAST(greatest(-1, least(1, tone / 10)) AS DECIMAL(24, 10)), 4) AS DOUBLE) AS tone, themes FROM b JOIN tt USING (country_code)")
def k43(t):
    return P.v1_nodes(R.theme_mentions(t.signals, F.col("signal_id") % 7))


GRID = """, a AS (SELECT (sqrt(3) / 3 * longitude - latitude / 3) / 2 AS q0, latitude * 2 / 3 / 2 AS r0 FROM signals), c0 AS (SELECT *, round(q0) AS q, round(r0) AS r, round(-q0 - r0) AS s FROM a), c1 AS (SELECT q, r, s, abs(q - q0) AS dq, abs(r - r0) AS dr, abs(s + q0 + r0) AS ds FROM c0),
 c AS (SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END AS INTEGER) AS q, CAST(CASE WHEN dr > ds AND NOT (dq > dr AND dq > ds) THEN -q - s ELSE r END AS INTEGER) AS r, count(*)::DOUBLE AS i FROM c1 GROUP BY ALL),
 k AS (SELECT unnest(range(-2, 3)) AS d), n AS (SELECT q + x.d AS q, r + y.d AS r, i / (1 + (abs(x.d) + abs(y.d) + abs(x.d + y.d)) / 2) AS v FROM c, k x, k y WHERE (abs(x.d) + abs(y.d) + abs(x.d + y.d)) / 2 <= 2), o AS (SELECT q, r, sum(v) AS v FROM n GROUP BY ALL)"""


@query("k49_grid_smooth", GRID + " SELECT CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r, round(v / max(v) OVER (), 6) AS intensity FROM o")
def k49(t):
    return P.grid_smooth(t.signals.select("latitude", "longitude", F.lit(1.0).alias("intensity")))


# Joins


@query("d1_dimension_join", "SELECT name, region, count(*) AS n FROM signals LEFT JOIN countries USING (country_code) GROUP BY ALL")
def d1(t):
    return t.signals.join(t.countries.select("country_code", "name", "region"), "country_code", "left").groupBy("name", "region").agg(F.count("*").alias("n"))


@query("d5_scalar_join", "SELECT country_code, round(count(*) / (SELECT count(*) FROM signals), 6) AS share FROM signals GROUP BY ALL")
def d5(t):
    return t.signals.groupBy("country_code").agg(F.count("*").alias("n")).join(F.broadcast(t.signals.agg(F.count("*").alias("every")))).select("country_code", R.r(F.col("n") / F.col("every")).alias("share"))


@query("d6_lateral_unnest", ", e AS (SELECT signal_id, unnest(CASE WHEN len(list_filter(themes, lambda x: x LIKE 'K%' AND x > 'K4')) = 0 THEN ['__none__'] ELSE list_filter(themes, lambda x: x LIKE 'K%' AND x > 'K4') END) AS theme FROM signals) SELECT theme, count(*) AS n FROM e GROUP BY ALL")
def d6(t):
    some = t.signals.withColumn("themes", F.filter("themes", lambda x: x.startswith("K") & (x > "K4")))
    return R.exploded(some, outer=True).groupBy("theme").agg(F.count("*").alias("n"))


@query("d9_full_outer_themes", EXPLODED + ", a AS (SELECT theme, count(*) AS n_a FROM t WHERE country_code = 'N01' GROUP BY ALL), b AS (SELECT theme, count(*) AS n_b FROM t WHERE country_code = 'N02' GROUP BY ALL) SELECT theme, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (theme)")
def d9(t):
    per = lambda c, n: R.exploded(t.signals.where(F.col("country_code") == c)).groupBy("theme").agg(F.count("*").alias(n))
    return per("N01", "n_a").join(per("N02", "n_b"), "theme", "full").na.fill(0)


@query("d11_semi_join", ", b AS (SELECT country_code FROM signals WHERE is_crisis GROUP BY ALL HAVING count(*) > 100) SELECT country_code, count(*) AS n FROM signals SEMI JOIN b USING (country_code) GROUP BY ALL")
def d11(t):
    busy = t.signals.where("is_crisis").groupBy("country_code").agg(F.count("*").alias("k")).where("k > 100")
    return t.signals.join(busy, "country_code", "left_semi").groupBy("country_code").agg(F.count("*").alias("n"))


@query("d12_anti_join", "SELECT signal_id FROM signals WHERE source_url NOT IN (SELECT source_url FROM signals WHERE source_family = 'wire')")
def d12(t):
    return t.signals.join(t.signals.where("source_family = 'wire'").select("source_url"), "source_url", "left_anti").select("signal_id")


@query("d13_band_join", "SELECT country_code, count(*) AS n FROM signals s JOIN countries c USING (country_code) WHERE abs(s.latitude - c.latitude) <= 0.3 AND abs(s.longitude - c.longitude) <= 0.1 GROUP BY ALL")
def d13(t):
    places = t.countries.select("country_code", F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"))
    near = (F.abs(F.col("latitude") - F.col("lat0")) <= 0.3) & (F.abs(F.col("longitude") - F.col("lon0")) <= 0.1)
    return t.signals.join(places, "country_code").where(near).groupBy("country_code").agg(F.count("*").alias("n"))


@query("d10_common_outlets", "SELECT source_name FROM (SELECT DISTINCT source_name FROM signals WHERE country_code = 'N03') JOIN (SELECT DISTINCT source_name FROM signals WHERE country_code = 'N04') USING (source_name)")
def d10(t):
    of = lambda c: t.signals.where(F.col("country_code") == c).select("source_name").distinct()
    return of("N03").join(of("N04"), "source_name")


@query("d20_edition_fan_out", ", e AS (SELECT region AS edition, country_code FROM countries), p AS (SELECT region AS edition, title, CAST(sum(views) AS BIGINT) AS views FROM pageviews JOIN countries USING (country_code) GROUP BY ALL) SELECT e.country_code, title, views FROM p JOIN e USING (edition)")
def d20(t):
    editions = t.countries.select(F.col("region").alias("edition"), "country_code")
    pages = t.pageviews.join(editions, "country_code").groupBy("edition", "title").agg(F.sum("views").alias("views"))
    return pages.join(editions, "edition").select("country_code", "title", "views")
