"""Queries of parts that other queries only use inside: windows, single parsers, pairs, bridges, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, exprs
from ..operators import heat as H
from ..operators import pairs as P
from ..operators import rollups as R
from ..sources import parse
from ..sources import sinks as K
from ..streaming import stream as M
from .fixture import AS_OF
from .heat import ANOMALIES, BASE
from .landing import gkg_lines
from .reference import THEMES, VALUES, dealt, dealt_sql
from .registry import query

GOOD = "WHERE signal_id % 10 NOT IN (3, 7)"
RECORD = "concat('r', CAST(signal_id AS VARCHAR)) AS record_id"


@query("b1_window", f"SELECT signal_id FROM signals WHERE {BASE(96, 24)}")
def b1(t):
    """Rows from 96 to 24 hours before; both ends as the rule has them."""
    return t.signals.where(exprs.in_window(F.col("ts"), AS_OF, 96, 24)).select("signal_id")


CATEGORIES = [(t, c) for c, ts in dims.THEME_CATEGORIES.items() for t in ts]


@query("c9_theme_categories", dealt_sql(THEMES, "theme") + f" SELECT signal_id, coalesce(category, 'other') AS category FROM x LEFT JOIN {VALUES(CATEGORIES)} m(code, category) ON code = upper(theme)")
def c9(t):
    return dealt(t, THEMES, "theme").select("signal_id", exprs.theme_category(F.col("theme")).alias("category"))


@query("c34_crisis", ", s AS (SELECT signal_id, CASE signal_id % 6 WHEN 0 THEN ['WB_FLOOD', 'ECON_X'] WHEN 1 THEN ['TERROR_A', 'PROTEST', 'Y', 'Z'] WHEN 2 THEN ['DROUGHT'] WHEN 3 THEN ['STRIKE', 'Q'] WHEN 4 THEN ['kill', 'FAMINE', 'W'] ELSE [] END AS th FROM signals) SELECT signal_id, signal_id % 6 NOT IN (3, 5) AS is_crisis, CASE signal_id % 6 WHEN 0 THEN 0.6 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 WHEN 4 THEN round(2 / 3 + 0.3, 6) ELSE 0 END::DOUBLE AS crisis_score, CASE signal_id % 6 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 4 THEN 'critical' ELSE 'low' END AS severity, CASE signal_id % 6 WHEN 0 THEN 'natural_disaster' WHEN 1 THEN 'civil_unrest' WHEN 2 THEN 'natural_disaster' WHEN 4 THEN 'humanitarian' ELSE 'other' END AS event_type FROM s")
def c34(t):
    """Mixed cases, several levels at once, themes without a crisis, and none."""
    k = F.col("signal_id") % 6
    some = lambda *xs: F.array(*map(F.lit, xs))
    themes = F.when(k == 0, some("WB_FLOOD", "ECON_X")).when(k == 1, some("TERROR_A", "PROTEST", "Y", "Z")).when(k == 2, some("DROUGHT")).when(k == 3, some("STRIKE", "Q")).when(k == 4, some("kill", "FAMINE", "W")).otherwise(F.array().cast("array<string>"))
    return t.signals.select("signal_id", exprs.crisis(themes).alias("c")).select("signal_id", "c.is_crisis", R.r(F.col("c.crisis_score")).alias("crisis_score"), "c.severity", "c.event_type")


@query("d8_shared_outlets", ", e AS (SELECT DISTINCT country_code AS o, source_name AS e FROM signals) SELECT x.o AS a, y.o AS b, count(*) AS shared FROM e x JOIN e y USING (e) WHERE x.o < y.o GROUP BY ALL")
def d8(t):
    return P.shared_pairs(t.signals.select("country_code", "source_name").distinct(), "country_code", "source_name")


@query("h2_outlet_overlap", ", e AS (SELECT DISTINCT country_code AS o, source_name AS e FROM signals WHERE signal_id % 3 = 0), z AS (SELECT o, count(*) AS n FROM e GROUP BY ALL) SELECT x.o AS a, y.o AS b, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 6) AS jaccard FROM e x JOIN e y USING (e) JOIN z za ON za.o = x.o JOIN z zb ON zb.o = y.o WHERE x.o < y.o GROUP BY ALL")
def h2(t):
    sets = t.signals.where("signal_id % 3 = 0").select("country_code", "source_name").distinct()
    return P.jaccard_pairs(sets, "country_code", "source_name").select("a", "b", R.r(F.col("jaccard")).alias("jaccard"))


@query("d16_titles_with_words", ", h AS (SELECT DISTINCT title FROM pageviews), w AS (SELECT DISTINCT lower(event_type) AS word FROM signals UNION SELECT '_1' UNION SELECT 'er') SELECT title, word FROM h JOIN w ON contains(lower(title), word)")
def d16(t):
    words = t.signals.select(F.lower("event_type").alias("word")).union(t.spark.createDataFrame([("_1",), ("er",)], "word string")).distinct()
    titles = t.pageviews.select("title").distinct().withColumn("low", F.lower("title"))
    return R.containing(titles, "low", words, "word").select("title", "word").distinct()


@query("d17_stance_drift", ", s AS (SELECT signal_id, source_name, nlp_framing AS label, sentiment AS score, lag(nlp_framing) OVER w AS pl, lag(sentiment) OVER w AS ps FROM signals WINDOW w AS (PARTITION BY source_name ORDER BY ts, signal_id)) SELECT signal_id, coalesce(pl <> label, false) AS changed, round(abs(score - ps), 6) AS drift FROM s")
def d17(t):
    stances = t.signals.select("signal_id", "ts", "source_name", F.col("nlp_framing").alias("label"), F.col("sentiment").alias("score"))
    return R.stance_drift(stances, ["source_name"]).select("signal_id", "changed", "drift")


@query("d19_bridge_rows", "SELECT signal_id, theme, 'theme' AS part FROM (SELECT signal_id, unnest(themes) AS theme FROM signals) UNION ALL SELECT signal_id, name, 'person' FROM (SELECT signal_id, unnest(persons) AS name FROM signals)")
def d19(t):
    parts = K.to_bridges(t.signals)
    return parts["themes"].withColumn("part", F.lit("theme")).union(parts["entities"].select("signal_id", "name", "type"))


@query("g2_top_anomalies", ANOMALIES + " SELECT country_code, zscore, level FROM lv ORDER BY zscore DESC NULLS LAST, country_code LIMIT 5")
def g2(t):
    return H.country_anomalies(R.country_hourly(t.signals), t.countries, AS_OF, hours=72, days=14, limit=5).select("country_code", "zscore", "level")


@query("j7_named_offsets", f"SELECT {RECORD}, 'KILL' AS theme, CAST(signal_id AS INTEGER) AS at FROM signals {GOOD} UNION ALL SELECT {RECORD}, unnest(themes), 5 FROM signals {GOOD}")
def j7(t):
    return parse.read_gkg(gkg_lines(t))[0].select("record_id", F.explode("enhanced_themes").alias("x")).select("record_id", "x.theme", F.col("x.offset").alias("at"))


@query("j8_locations", f"SELECT {RECORD}, 3 AS location_type, 'Town, Land' AS full_name, ['UK', 'GM', 'US', 'FR'][signal_id % 4 + 1] AS country_code, latitude, longitude, '7' AS feature_id, 12 AS char_offset FROM signals {GOOD}")
def j8(t):
    return parse.read_gkg(gkg_lines(t))[0].select("record_id", F.explode("locations").alias("x")).select("record_id", *[f"x.{c}" for c in ("location_type", "full_name", "country_code", "latitude", "longitude", "feature_id", "char_offset")])


@query("j9_counts", f"SELECT {RECORD}, 'KILL' AS count_type, signal_id % 9 AS number, 'US' AS country, 1.5::DOUBLE AS latitude FROM signals {GOOD}")
def j9(t):
    return parse.read_gkg(gkg_lines(t))[0].select("record_id", F.explode("counts").alias("x")).select("record_id", "x.count_type", "x.number", F.col("x.location.country_code").alias("country"), "x.location.latitude")


@query("j10_tones", f"SELECT {RECORD}, sentiment AS tone, 1.0::DOUBLE AS positive, 5.0::DOUBLE AS self_ref, 60 AS words FROM signals {GOOD}")
def j10(t):
    return parse.read_gkg(gkg_lines(t))[0].select("record_id", "tone.tone", F.col("tone.positive_pct").alias("positive"), F.col("tone.self_group_ref").alias("self_ref"), F.col("tone.word_count").alias("words"))


@query("a17_exported_rows", "SELECT country_code, CAST(hour AS VARCHAR) AS hour, n FROM (SELECT country_code, date_trunc('hour', ts) AS hour, CAST(count(*) AS VARCHAR) AS n FROM signals GROUP BY ALL)")
def a17(t):
    """An hourly rollup as CSV, and what a reader of that gets."""
    path = M.scratch(t.spark, "export")
    rows = R.country_hourly(t.signals).select("country_code", F.col("hour").cast("string").alias("hour"), F.col("signal_count").alias("n"))
    K.export_csv(rows, path)
    return t.spark.read.option("header", True).csv(path)


@query("l3_newest_sample", ", nw AS (SELECT * FROM signals ORDER BY ts DESC, signal_id LIMIT 600) SELECT signal_id FROM nw QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), country_code ORDER BY ts DESC, signal_id) <= 2")
def l3(t):
    """Two rows of each day and country, of the newest 600."""
    return R.stratified_sample(t.signals, ["country_code"], 2, newest=600).select("signal_id")
