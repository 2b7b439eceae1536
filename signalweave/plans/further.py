"""Queries: keys seen before, retention by partition, sketches, grouping sets, places by radius, functions called from SQL alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import exprs, sql
from ..operators import heat, near, pairs, quality, sketches
from ..operators import rollups as R
from ..sources import partitions
from ..sources.seen import SeenKeys
from ..streaming import stream as M
from .fixture import AS_OF
from .heat import NOW
from .reference import LIST, dealt, dealt_sql
from .registry import query
from .streams import IN_TIME, staged


@query("a15_seen_keys", ", b AS (SELECT source_url, min(signal_id % 4) AS batch FROM signals GROUP BY ALL) SELECT CAST(batch AS INTEGER) AS batch, source_url, min(signal_id) AS signal_id FROM signals JOIN b USING (source_url) WHERE signal_id % 4 = batch GROUP BY ALL")
def a15(t):
    """Four batches against the index: the rows whose URL no earlier batch had, the first of each."""
    index = SeenKeys(t.spark, M.scratch(t.spark, "seen"), buckets=4, filter_bytes=4096)
    rows = t.signals.select("signal_id", "source_url")
    found = [index.new_rows(rows.where(F.col("signal_id") % 4 == b), "source_url", b, [F.asc("signal_id")]).withColumn("batch", F.lit(b)) for b in range(4)]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("n1_retained_partitions", "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, count(*) AS n FROM signals WHERE ts >= {AS_OF} - INTERVAL 332 HOURS GROUP BY ALL")
def n1(t):
    """A table by day after retention: whole days gone, the day of the limit written again."""
    path = M.scratch(t.spark, "retained")
    partitions.overwrite(t.signals.select("signal_id", "ts").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), path, ["day"])
    partitions.retain(t.spark, path, "2024-01-31 04:00:00", 14, True)
    return t.spark.read.parquet(path).groupBy(R.day().cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))


DAYS = "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, country_code, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, count(DISTINCT source_name) AS sources, count(DISTINCT country_code) AS countries FROM signals {} GROUP BY ALL"
COUNTED = {"sources": "source_name", "countries": "country_code"}


def _days(hours):
    per = sketches.estimated(sketches.merged(hours, ["country_code"], "day", COUNTED), COUNTED)
    return per.select(F.col("hour").cast("date").cast("string").alias("day"), *[c for c in per.columns if c != "hour"])


@query("e11_days_from_sketched_hours", DAYS.format(""))
def e11(t):
    """Distinct outlets of days, merged from the sketches of hours."""
    return _days(sketches.sketched_hourly(t.signals, ["country_code"], COUNTED))


@query("m4_sketched_stream", DAYS.format("WHERE ts < TIMESTAMP '2024-01-21' AND (ts >= TIMESTAMP '2024-01-11' OR signal_id % 10 NOT IN (0, 1) OR (ts >= TIMESTAMP '2024-01-05' AND signal_id % 10 = 0))"))
def m4s(t):
    """The same from a stream of three batches, some rows late: its last state of each hour, merged to days."""
    path = M.scratch(t.spark, "m4s")
    M.run_available(sketches.stream_sketched(staged(t, IN_TIME), ["country_code"], "10 days", COUNTED), M.update_log(path), path + "-checkpoint", "update")
    return _days(M.latest_of_log(t.spark, path, ["hour", "country_code"]))


@query("e3_grouping_sets", "SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS slot, country_code, source_family, array_to_string(list_filter([CASE WHEN grouping(country_code) = 0 THEN 'country_code' END, CASE WHEN grouping(source_family) = 0 THEN 'source_family' END], lambda x: x IS NOT NULL), ',') AS kind, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, count(DISTINCT source_name) AS sources FROM signals GROUP BY GROUPING SETS ((date_trunc('day', ts), country_code), (date_trunc('day', ts), source_family), (date_trunc('day', ts), country_code, source_family), (date_trunc('day', ts)))")
def e3(t):
    """Days by country, by family, by both and altogether in one pass."""
    rows = R.grouped_sets(t.signals, [["country_code"], ["source_family"], ["country_code", "source_family"], []], "day")
    return rows.withColumn("slot", F.col("slot").cast("date").cast("string"))


_DISTANCE = "6371.0 * 2 * atan2(sqrt(a), sqrt(greatest(1 - a, 0)))"
_PAIRS = ", p AS (SELECT country_code AS place, latitude AS la, longitude AS lo, 150.0 * (1 + ascii(right(country_code, 1)) % 9) AS km FROM countries), a AS (SELECT signal_id, place, km, pow(sin(radians(la - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(la)) * pow(sin(radians(lo - longitude) / 2), 2) AS a FROM signals, p), d AS (SELECT signal_id, place, " + _DISTANCE + " AS distance, km FROM a), w AS (SELECT signal_id, place, distance FROM d WHERE distance <= km)"


def _places(t):
    return t.countries.select(F.col("country_code").alias("place"), "latitude", "longitude", (150.0 * (1 + F.ascii(F.substring("country_code", -1, 1)) % 9)).alias("km"))


@query("d13_places_in_radius", _PAIRS + " SELECT signal_id, place, round(distance, 6) AS distance FROM w")
def d13(t):
    """Every signal with each country whose radius, 150 to 1350 km, it is in."""
    return near.within_radius(t.signals.select("signal_id", "latitude", "longitude"), _places(t)).select("signal_id", "place", R.r(F.col("distance")).alias("distance"))


@query("d15_nearest_place", _PAIRS + " SELECT signal_id, arg_min(place, {'d': distance, 'p': place}) AS place FROM w GROUP BY ALL")
def d15(t):
    return near.nearest_place(t.signals.select("signal_id", "latitude", "longitude"), _places(t), "signal_id").select("signal_id", "place")


#: Blocks of landed records: good ones, types out of range, too few parts, no name or country, coordinates empty, out of range, or no numbers.
BLOCKS = ["", "3#Town#US#CA##34.5#-118.2#9#77", "0#Town#US#CA##1#2#9#7;5#Vila#BR#BR1##-23.5#-46.6#8#x", "6#Town#US#CA##1#2#9#7", "x#Town#US#CA##1#2#9#7;1#Land#FR#####f#;", "2#Short#US#CA", "4##US#CA##1#2#9#7;4#Town###CA#1#2#9#7", "4#Town#DE#D1##abc#2#9#7; 4 # Spaced # DE #D1## 5.5 # 6.5 #9# 3 ", "1#Pole#NO###95.5#-190#9#1", "3#A#US###1#2#;3#A#US###1#2#;5#B#MX#M#M2#3.25#4#6#5#extra"]
_LOCATIONS = ", b AS (SELECT signal_id, trim(unnest(string_split(v, ';'))) AS b FROM x), q AS (SELECT signal_id, list_transform(string_split(b, '#'), lambda y: trim(y)) AS p FROM b WHERE regexp_matches(b, '^[ \\t]*[1-5][ \\t]*#')), g AS (SELECT *, TRY_CAST(p[6] AS DOUBLE) AS la, TRY_CAST(p[7] AS DOUBLE) AS lo FROM q WHERE len(p) >= 7 AND p[2] <> '' AND p[3] <> '') SELECT signal_id, CAST(p[1] AS INTEGER) AS location_type, p[2] AS full_name, p[3] AS country_code, CASE WHEN abs(la) <= 90 THEN la ELSE 0 END::DOUBLE AS latitude, CASE WHEN abs(lo) <= 180 THEN lo ELSE 0 END::DOUBLE AS longitude, coalesce(p[8], '') AS feature_id, coalesce(TRY_CAST(p[9] AS INTEGER), 0) AS char_offset FROM g WHERE (p[6] = '' OR la IS NOT NULL) AND (p[7] = '' OR lo IS NOT NULL)"


@query("j8_location_blocks", dealt_sql(BLOCKS, "v") + _LOCATIONS)
def j8(t):
    """All kinds of blocks through the parser."""
    from ..sources import parse

    rows = dealt(t, BLOCKS, "v").select("signal_id", F.explode(parse.locations(F.col("v"))).alias("l"))
    return rows.select("signal_id", *[f"l.{c}" for c in ("location_type", "full_name", "country_code", "latitude", "longitude", "feature_id", "char_offset")])


@query("j8_lateral_locations", dealt_sql(BLOCKS, "v") + _LOCATIONS)
def j8s(t):
    """The same from SQL alone, by a function that returns a table."""
    sql.register(t.spark)
    return t.spark.sql("SELECT signal_id, l.location_type, l.full_name, l.country_code, l.latitude, l.longitude, l.feature_id, l.char_offset FROM {x} x, LATERAL sw_parse_locations(x.v) l", x=dealt(t, BLOCKS, "v").select("signal_id", "v"))


COUNTS = ["", "KILL#12##3#Palisades#US#USCA#34.5#-118.5#11", "KILL#12#civilians;ARREST#x#;#5#;ONE", "WOUND#-3#a#1#L#FR##95#7#8; PROTEST # 4 #b#1#L#FR##5#7#8", "KILL#2#a#3#T#US#A#abc#1#1;KILL#2#a#3#T#US#A#abc#1#1"]
_COUNTS = ", b AS (SELECT signal_id, trim(unnest(string_split(v, ';'))) AS b FROM x), q AS (SELECT signal_id, list_transform(string_split(b, '#'), lambda y: trim(y)) AS p FROM b) SELECT signal_id, p[1] AS count_type, TRY_CAST(p[2] AS BIGINT) AS number, coalesce(p[3], '') AS object_type, CASE WHEN len(p) >= 10 THEN p[6] END AS country_code, CASE WHEN len(p) >= 10 THEN CASE WHEN abs(TRY_CAST(p[8] AS DOUBLE)) <= 90 THEN TRY_CAST(p[8] AS DOUBLE) ELSE 0 END END::DOUBLE AS latitude FROM q WHERE len(p) >= 2 AND p[1] <> '' AND TRY_CAST(p[2] AS BIGINT) IS NOT NULL"


@query("j9_count_blocks", dealt_sql(COUNTS, "v") + _COUNTS)
def j9(t):
    from ..sources import parse

    rows = dealt(t, COUNTS, "v").select("signal_id", F.explode(parse.counts(F.col("v"))).alias("c"))
    return rows.select("signal_id", "c.count_type", "c.number", "c.object_type", F.col("c.location.country_code").alias("country_code"), F.col("c.location.latitude").alias("latitude"))


@query("j9_lateral_counts", dealt_sql(COUNTS, "v") + _COUNTS)
def j9s(t):
    sql.register(t.spark)
    return t.spark.sql("SELECT signal_id, c.count_type, c.number, c.object_type, c.country_code, c.latitude FROM {x} x, LATERAL sw_parse_counts(x.v) c", x=dealt(t, COUNTS, "v").select("signal_id", "v"))


WORDS = ["Kyiv", "tehran", "junta", "Military Junta", "nowhere", "LIMA"]


@query("p_functions_in_sql", ", m AS (SELECT country_code AS cc, latitude AS la, longitude AS lo FROM countries) SELECT signal_id, source_name AS host, CASE WHEN attribution_method = 'reddit_public' OR source_family = 'social' THEN 'social_commentary' WHEN attribution_method = 'reliefweb_ocha' OR source_family = 'ngo' THEN 'humanitarian' WHEN is_state_media OR source_family = 'state' THEN 'state_media' WHEN source_family = 'wire' THEN 'wire' WHEN source_family IN ('gdelt', 'rss', 'api', 'independent') THEN 'reporting' ELSE 'unknown' END AS signal_class, " + LIST(WORDS) + "[signal_id % 6 + 1] AS word, CASE signal_id % 6 WHEN 0 THEN 'UA' WHEN 1 THEN 'IR' WHEN 2 THEN 'TH' WHEN 3 THEN 'MM' WHEN 5 THEN 'PE' END AS word_country, round(6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT *, pow(sin(radians(la - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(la)) * pow(sin(radians(lo - longitude) / 2), 2) AS a FROM signals JOIN m ON cc = country_code)")
def p(t):
    """Scalar functions, and one that returns a table, in one SQL query."""
    sql.register(t.spark)
    words = "array(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
    return t.spark.sql(
        f"""SELECT s.signal_id, sw_domain(s.source_url) AS host, sw_signal_class(s.source_family, s.attribution_method, s.is_state_media) AS signal_class, s.word, w.country_code AS word_country,
              CAST(round(CAST(sw_haversine_km(s.latitude, s.longitude, c.latitude, c.longitude) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS km
            FROM (SELECT *, {words}[signal_id % 6] AS word FROM {{s}}) s JOIN {{c}} c USING (country_code) LEFT JOIN LATERAL sw_countries_with_word(s.word) w""",
        s=t.signals, c=t.countries,
    )


@query("c26_signal_classes", ", c AS (SELECT *, CASE WHEN attribution_method = 'reddit_public' OR source_family = 'social' THEN 'social_commentary' WHEN attribution_method = 'reliefweb_ocha' OR source_family = 'ngo' THEN 'humanitarian' WHEN is_state_media OR source_family = 'state' THEN 'state_media' WHEN source_family = 'wire' THEN 'wire' WHEN source_family IN ('gdelt', 'rss', 'api', 'independent') THEN 'reporting' ELSE 'unknown' END AS signal_class FROM signals) SELECT country_code, signal_class, count(*) AS n FROM c GROUP BY ALL")
def c26(t):
    return t.signals.groupBy("country_code", exprs.signal_class(F.col("source_family"), F.col("attribution_method"), F.col("is_state_media")).alias("signal_class")).agg(F.count("*").alias("n"))


EDGES = [0.5, 0.51, -0.5, -0.49, -2.0, -2.01, -1.99, 0.0, 9.99, 10.0, 10.01, -10.0, -10.01, 250.0]


def _edge(t):
    return t.signals.select("signal_id", F.element_at(F.array(*map(F.lit, EDGES)), (F.col("signal_id") % len(EDGES) + 1).cast("int")).alias("x"))


_EDGE = f", x AS (SELECT signal_id, {EDGES}[signal_id % {len(EDGES)} + 1]::DOUBLE AS x FROM signals)"


@query("c30_framing_edges", _EDGE + " SELECT signal_id, CASE WHEN x > 0.5 THEN 'positive' WHEN x > -0.5 THEN 'neutral' WHEN x > -2 THEN 'negative' ELSE 'hostile' END AS framing FROM x")
def c30(t):
    return _edge(t).select("signal_id", exprs.framing_label(F.col("x")).alias("framing"))


@query("c32_clamped_edges", _EDGE + " SELECT signal_id, greatest(-1, least(1, x / 10))::DOUBLE AS tone FROM x")
def c32(t):
    return _edge(t).select("signal_id", exprs.clamped_tone(F.col("x")).alias("tone"))


@query("d2_window_against_baseline", f", w AS (SELECT country_code, count(*) AS n FROM signals WHERE {NOW(24)} GROUP BY ALL), d AS (SELECT country_code, date_trunc('day', ts) AS day, count(*) AS n FROM signals WHERE {NOW(240)} GROUP BY ALL), b AS (SELECT country_code, count(*) AS days, round(avg(n), 6) AS avg_daily FROM d GROUP BY ALL) SELECT country_code, n, days, avg_daily FROM w JOIN b USING (country_code)")
def d2(t):
    """Countries with rows in the last day, each with its daily mean of ten days."""
    now = t.signals.where(exprs.in_window(F.col("ts"), AS_OF, 24)).groupBy("country_code").agg(F.count("*").alias("n"))
    return now.join(heat.country_baseline(t.signals, AS_OF, 10), "country_code").select("country_code", "n", "days", "avg_daily")


@query("d7_pairs_in_rows", ", e AS (SELECT signal_id, unnest(list_distinct(list_concat(themes, persons))) AS x FROM signals) SELECT p.x AS a, q.x AS b, count(*) AS n FROM e p JOIN e q USING (signal_id) WHERE p.x < q.x GROUP BY ALL")
def d7(t):
    return pairs.row_pairs(t.signals.withColumn("both", F.concat("themes", "persons")), "both")


@query("d18_corrections_of_signals", " SELECT coalesce(source_lang, 'unknown') AS source_lang, source_family AS nlp_method, count(*) AS corrections, round(avg(abs(CASE WHEN signal_id % 2 = 0 THEN sentiment / 2 ELSE -sentiment END - sentiment)), 6) AS avg_delta, round(avg(CASE WHEN signal_id % 2 = 1 AND nlp_framing IS NOT NULL THEN 1 ELSE 0 END), 6) AS framing_rate FROM signals WHERE signal_id % 3 = 0 GROUP BY ALL")
def d18(t):
    """Corrections of a third of the signals; every other one changes the framing; some are of signals that there aren't."""
    own = t.signals.where("signal_id % 3 = 0")
    changed = F.when(F.col("signal_id") % 2 == 1, F.lit("other")).otherwise(F.col("nlp_framing"))
    corrections = own.select("signal_id", F.col("sentiment").alias("original_sentiment"), F.when(F.col("signal_id") % 2 == 0, F.col("sentiment") / 2).otherwise(-F.col("sentiment")).alias("corrected_sentiment"), F.col("nlp_framing").alias("original_framing"), changed.alias("corrected_framing"))
    stray = corrections.withColumn("signal_id", -F.col("signal_id") - 1)
    return quality.nlp_calibration(corrections.unionByName(stray), t.signals.withColumn("nlp_method", F.col("source_family")))


@query("f4_shares_of_countries", "SELECT country_code, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM signals GROUP BY ALL")
def f4(t):
    return R.share_of_total(t.signals, "country_code")


@query("g1_strongest_signals", "SELECT signal_id, country_code, sentiment FROM signals ORDER BY abs(sentiment) DESC, signal_id LIMIT 40")
def g1(t):
    return t.signals.orderBy(F.desc(F.abs("sentiment")), "signal_id").limit(40).select("signal_id", "country_code", "sentiment")
