"""Queries: themes, narratives, countries, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import rollups as R
from ..operators import themes as T
from .aggregates import EXPLODED, HOUR
from .fixture import AS_OF
from .heat import BASE, NOW, ROUND2
from .registry import query

TOP3 = lambda src, key, name, col: f"(SELECT {col}, string_agg({key}, ',' ORDER BY rk) AS {name} FROM (SELECT {col}, {key}, row_number() OVER (PARTITION BY {col} ORDER BY count(*) DESC, {key}) AS rk FROM {src} GROUP BY {col}, {key}) WHERE rk <= 3 GROUP BY {col})"

NARR = f""", w AS (SELECT * FROM signals WHERE {NOW(240)}), t AS (SELECT * EXCLUDE (themes), unnest(themes) AS theme FROM w), top AS (SELECT theme, count(*) AS signal_count, round(avg(sentiment), 4) AS avg_sentiment FROM t GROUP BY ALL ORDER BY signal_count DESC, theme LIMIT 12),
 f AS (SELECT t.* FROM t SEMI JOIN top USING (theme)), sc AS (SELECT theme, count(DISTINCT country_code) AS country_count, count(DISTINCT source_name) AS source_count, count(*) FILTER (WHERE {NOW(72)}) AS velocity, count(*) FILTER (WHERE {BASE(144, 72)}) AS before, CAST(min(ts) AS VARCHAR) AS first_seen FROM f GROUP BY ALL),
 pp AS (SELECT theme, unnest(persons) AS person FROM f), tl AS (SELECT theme, string_agg(day || ':' || n, ',' ORDER BY day) AS timeline FROM (SELECT theme, strftime(ts, '%m-%d') AS day, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL)
 SELECT top.*, country_count, source_count, velocity, first_seen, top_countries, top_persons, timeline, CASE WHEN before > 0 AND velocity > before * 1.2 THEN 'accelerating' WHEN before > 0 AND velocity < before * 0.8 THEN 'fading' ELSE 'stable' END AS trend, round(100.0 * country_count / (SELECT count(DISTINCT country_code) FROM w), 1) AS spread_pct{{X}}
 FROM top LEFT JOIN sc USING (theme) LEFT JOIN {TOP3('f', 'country_code', 'top_countries', 'theme')} USING (theme) LEFT JOIN {TOP3('{P}', 'person', 'top_persons', 'theme')} USING (theme) LEFT JOIN tl USING (theme)"""


@query("k11_narratives", NARR.replace("{P}", "pp").replace("{X}", ""))
def k11(t):
    return HOUR(T.narratives(t.signals, AS_OF, 240, 12, velocity_hours=72))


@query("k11_narratives_zipped", NARR.replace("{P}", "(SELECT theme, person FROM (SELECT unnest(themes) AS theme, unnest(persons) AS person FROM w) WHERE theme IS NOT NULL AND person IS NOT NULL) zz").replace("{X}", ""))
def k11z(t):
    """Themes paired with persons by place."""
    return HOUR(T.narratives(t.signals, AS_OF, 240, 12, velocity_hours=72, zipped=True))


@query("k11_interest_flags", EXPLODED + ", x AS (SELECT DISTINCT theme FROM t), w AS (SELECT theme, unnest(string_split(lower(replace(theme, '_', ' ')), ' ')) AS word FROM x) SELECT theme, bool_or(length(word) > 3 AND EXISTS (SELECT 1 FROM trends WHERE keyword LIKE '%' || word || '%')) AS interested FROM w GROUP BY ALL")
def k11f(t):
    return T.interest_flags(R.exploded(t.signals).select("theme").distinct(), t.trends, "keyword")


BUNDLE = ["CLICK", "K3", "SEG_BUILDING"]


@query("k12_concept_summary", f"SELECT country_code, count(*) AS signal_count, round(avg(sentiment), 6) AS tone, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, array_to_string(list_slice(list_sort(list(DISTINCT source_name)), 1, 5), ',') AS sources FROM signals WHERE {NOW(480)} AND list_has_any(themes, ['CLICK', 'K3', 'SEG_BUILDING']) GROUP BY ALL")
def k12(t):
    return HOUR(T.concept_summary(t.signals, BUNDLE, AS_OF, 480))


@query("k12_concept_from_rollup", EXPLODED + ", h AS (SELECT theme, country_code, date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(sentiment), 6) AS a FROM t WHERE theme IN ('CLICK', 'K3', 'SEG_BUILDING') GROUP BY ALL) SELECT country_code, CAST(sum(n) AS BIGINT) AS signal_count, round(sum(a * n) / sum(n), 6) AS tone FROM h GROUP BY ALL")
def k12r(t):
    return T.concept_from_rollup(R.theme_country_hourly(t.signals), BUNDLE)


@query("k13_related_themes", EXPLODED + ", x AS (SELECT signal_id FROM t WHERE theme = 'K1') SELECT theme AS other, count(*) AS n, count(DISTINCT country_code) AS countries FROM t SEMI JOIN x USING (signal_id) WHERE theme <> 'K1' GROUP BY ALL ORDER BY n DESC, other LIMIT 10")
def k13r(t):
    return T.theme_detail(t.signals, "K1", AS_OF, 720)["related"]


@query("k13_framing_by_country", f""", x AS (SELECT * FROM signals WHERE list_contains(themes, 'K1')), o AS (SELECT country_code, unnest(themes) AS other FROM x), oo AS (SELECT * FROM o WHERE other <> 'K1'), b AS (SELECT country_code, count(*) AS n, round(avg(sentiment), 6) AS tone FROM x GROUP BY ALL)
 SELECT country_code, n, tone, sub_themes, CASE WHEN tone > 0.5 THEN 'positive' WHEN tone > -0.5 THEN 'neutral' WHEN tone > -2 THEN 'negative' ELSE 'hostile' END AS framing FROM b LEFT JOIN {TOP3('oo', 'other', 'sub_themes', 'country_code')} USING (country_code)""")
def k13f(t):
    return T.theme_detail(t.signals, "K1", AS_OF, 744)["framing"]


@query("k13_theme_timeline", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(avg(sentiment), 6) AS tone FROM signals WHERE list_contains(themes, 'K1') GROUP BY ALL")
def k13t(t):
    return HOUR(T.theme_detail(t.signals, "K1", AS_OF, 744)["timeline"])


@query("k13_theme_sources", "SELECT source_name, count(*) AS n, 'independent' AS family, round(avg(sentiment), 6) AS tone FROM signals WHERE list_contains(themes, 'K1') GROUP BY ALL ORDER BY n DESC, source_name LIMIT 10")
def k13s(t):
    return T.theme_detail(t.signals, "K1", AS_OF, 744)["sources"]


@query("k14_theme_drift", "SELECT CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS day, count(*) AS signal_count, round(avg(sentiment), 6) AS tone FROM signals WHERE list_contains(themes, 'CLICK') GROUP BY ALL")
def k14(t):
    return HOUR(T.theme_drift(t.signals, "CLICK"))


@query("k15_theme_spikes", ", s AS (SELECT *, CASE WHEN signal_id % 3 <> 0 THEN source_url END AS url FROM signals WHERE list_contains(themes, 'CLICK')), h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS signal_count, arg_min({'u': url, 's': source_name, 'c': country_code, 't': CAST(round(CAST(sentiment AS DECIMAL(24, 8)), 3) AS DOUBLE)}, (ts, signal_id)) FILTER (WHERE url IS NOT NULL) AS x FROM s GROUP BY ALL), l AS (SELECT *, lag(signal_count) OVER (ORDER BY hour) AS previous FROM h) SELECT CAST(hour AS VARCHAR) AS hour, signal_count, previous, CAST(round(CAST(100.0 * (signal_count - previous) / previous AS DECIMAL(24, 8)), 1) AS DOUBLE) AS pct, x.u AS trigger_url, x.s AS trigger_source, x.c AS trigger_country, x.t AS trigger_tone FROM l WHERE signal_count > previous ORDER BY pct DESC, l.hour LIMIT 10")
def k15(t):
    """A third of the rows has no URL, so these are no triggers."""
    return HOUR(T.theme_spikes(t.signals.withColumn("source_url", F.when(F.col("signal_id") % 3 != 0, F.col("source_url"))), "CLICK"))


MOMENTUM = f", t AS (SELECT ts, unnest(themes) AS theme FROM signals), m AS (SELECT theme, count(*) FILTER (WHERE {NOW(48)}) AS recent, count(*) FILTER (WHERE {BASE(96, 48)}) AS before FROM t WHERE {NOW(96)} GROUP BY ALL), mo AS (SELECT *, CASE WHEN recent / nullif(before, 0) >= 1.5 THEN 'accelerating' WHEN recent / nullif(before, 0) <= 0.5 THEN 'declining' WHEN before = 0 AND recent > 0 THEN 'new' ELSE 'steady' END AS momentum FROM m)"


@query("k16_theme_momentum", MOMENTUM + " SELECT * FROM mo")
def k16(t):
    return T.theme_momentum(t.signals, AS_OF, 48)


@query("k17_focus_themes", ", f AS (SELECT * FROM signals WHERE len(list_filter(persons, lambda p: contains(lower(p), 'person 3'))) > 0), t AS (SELECT unnest(themes) AS theme, sentiment FROM f) SELECT theme, count(*) AS n, round(avg(sentiment), 6) AS tone FROM t GROUP BY ALL ORDER BY n DESC, theme LIMIT 10")
def k17(t):
    return T.focus_summary(t.signals, "person", "Person 3")["themes"]


@query("k17_focus_headlines", ", f AS (SELECT * FROM signals WHERE contains(lower(source_name), 'src7') QUALIFY row_number() OVER (PARTITION BY substr(source_url, 1, 30) ORDER BY ts DESC, signal_id) = 1) SELECT signal_id, headline FROM f ORDER BY ts DESC, signal_id LIMIT 10")
def k17h(t):
    return T.focus_summary(t.signals, "source", "src7")["headlines"].select("signal_id", "headline")


@query("k18_country_detail", f""", t AS (SELECT country_code, unnest(themes) AS theme FROM signals), p AS (SELECT country_code, unnest(persons) AS person FROM signals),
 b AS (SELECT country_code, count(*) AS signal_count, round(avg(sentiment), 6) AS tone, count(DISTINCT source_name) AS sources, CASE WHEN count(source_origin_country) > 50 THEN round(100.0 * count(*) FILTER (WHERE source_origin_country <> country_code) / count(source_origin_country), 1) END AS foreign_pct FROM signals GROUP BY ALL)
 SELECT * FROM b LEFT JOIN {TOP3('t', 'theme', 'top_themes', 'country_code')} USING (country_code) LEFT JOIN {TOP3('signals', 'source_name', 'top_sources', 'country_code')} USING (country_code) LEFT JOIN {TOP3('p', 'person', 'top_persons', 'country_code')} USING (country_code)""")
def k18(t):
    return T.country_detail(t.signals)


@query("k19_source_timeline", "SELECT CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS at, count(*) AS n FROM signals WHERE source_name = 'src3.example.com' GROUP BY ALL")
def k19(t):
    return T.source_profile(t.signals, "src3.example.com", hourly=False)["timeline"].select(F.col("at").cast("string").alias("at"), "n")


@query("k19_source_totals", "SELECT count(*) AS n, count(DISTINCT country_code) AS countries, round(avg(sentiment), 6) AS tone FROM signals WHERE source_name = 'src3.example.com'")
def k19t(t):
    return T.source_profile(t.signals, "src3.example.com", hourly=False)["totals"]


@query("k20_compare_periods", f"SELECT country_code, count(*) FILTER (WHERE {NOW(96)}) AS current, count(*) FILTER (WHERE {BASE(192, 96)}) AS previous, round(avg(sentiment) FILTER (WHERE {NOW(96)}) - avg(sentiment) FILTER (WHERE {BASE(192, 96)}), 6) AS tone_delta, current - previous AS delta, coalesce({ROUND2('100.0 * (current - previous) / nullif(previous, 0)')}, 0) AS pct FROM signals WHERE {NOW(192)} GROUP BY ALL")
def k20(t):
    return T.compare_periods(t.signals, "country_code", AS_OF, 96)


@query("k21_trend_series", ", h AS (SELECT country_code, date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(sentiment), 6) AS a FROM signals GROUP BY ALL) SELECT country_code, CAST(CAST(date_trunc('day', hour) AS TIMESTAMP) AS VARCHAR) AS at, CAST(sum(n) AS BIGINT) AS signal_count, CAST(round(CAST(avg(a) AS DECIMAL(24, 10)), 4) AS DOUBLE) AS tone FROM h GROUP BY ALL")
def k21(t):
    return T.trend_series(R.country_hourly(t.signals), ["country_code"], "day").withColumn("at", F.col("at").cast("string"))


@query("k22_briefing_tones", f", c AS (SELECT country_code, count(*) AS n, round(avg(sentiment), 6) AS tone FROM signals WHERE {NOW(240)} GROUP BY ALL HAVING count(*) > 10), a AS (SELECT 'most_negative' AS part, * FROM c ORDER BY tone, country_code LIMIT 5), b AS (SELECT 'most_positive' AS part, * FROM c ORDER BY tone DESC, country_code LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b")
def k22(t):
    parts = T.briefing(t.signals, AS_OF, 240)
    return parts["most_negative"].withColumn("part", F.lit("most_negative")).unionByName(parts["most_positive"].withColumn("part", F.lit("most_positive")))


@query("k22_briefing_theme_countries", f", t AS (SELECT country_code, unnest(themes) AS theme FROM signals WHERE {NOW(240)}), c AS (SELECT theme, country_code, count(*) AS n FROM t GROUP BY ALL) SELECT theme, country_code, n, CAST(row_number() OVER (PARTITION BY theme ORDER BY n DESC, country_code) AS INTEGER) AS rank FROM c QUALIFY rank <= 4")
def k22t(t):
    return T.briefing(t.signals, AS_OF, 240)["theme_countries"]


@query("k23_insight_facts", MOMENTUM.replace("48", "6").replace("96", "12") + f", s AS (SELECT * EXCLUDE (themes), unnest(themes) AS theme FROM signals WHERE {NOW(240)}), f AS (SELECT theme, count(*) AS n, count(DISTINCT country_code) AS countries, count(DISTINCT source_name) AS sources, round(avg(sentiment), 6) AS tone, round(min(sentiment), 6) AS lowest, round(max(sentiment), 6) AS highest FROM s GROUP BY ALL) SELECT f.*, momentum FROM f LEFT JOIN mo USING (theme)")
def k23(t):
    return T.insight_facts(t.signals, AS_OF, 240)
