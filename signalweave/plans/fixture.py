"""The signal tables as views over the driver's tables, in SQL that Spark and DuckDB both read, and their frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

#: Expressions that the two engines write differently.
SPARK = {"ARR": "array", "K": "get_json_object(props, '$.k')", "WORD": "element_at(split({0}, ' '), {1})"}
DUCK = {"ARR": "list_value", "K": "json_extract_string(props, '$.k')"}

EVENTS = "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, CAST({K} AS INT) AS k FROM {events}"

SIGNALS = """
SELECT e.event_id AS signal_id, e.ts AS ts, concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS country_code,
  CAST(c.c_nationkey * 5 - 60 AS DOUBLE) + CAST(e.k % 7 AS DOUBLE) / CAST(10 AS DOUBLE) AS latitude,
  CAST(c.c_nationkey * 14 - 170 AS DOUBLE) + CAST(e.k % 3 AS DOUBLE) / CAST(10 AS DOUBLE) AS longitude,
  (e.value - CAST(50 AS DOUBLE)) / CAST(10 AS DOUBLE) AS sentiment,
  concat('https://src', CAST(e.k % 20 AS STRING), '.example.com/', CAST(e.event_id % 400 AS STRING)) AS source_url,
  concat('src', CAST(e.k % 20 AS STRING), '.example.com') AS source_name,
  concat(e.event_type, ' in ', n.n_name, ' ', CAST(e.k % 10 AS STRING)) AS headline,
  {ARR}(upper(e.event_type), concat('SEG_', c.c_mktsegment), concat('K', CAST(e.k % 10 AS STRING))) AS themes,
  {ARR}(concat('person ', CAST(e.k % 17 AS STRING)), concat('visitor ', CAST(e.user_id % 5 AS STRING))) AS persons,
  CASE e.k % 5 WHEN 0 THEN 'gdelt' WHEN 1 THEN 'wire' WHEN 2 THEN 'state' WHEN 3 THEN 'social' ELSE 'independent' END AS source_family,
  CASE e.k % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'fr' ELSE NULL END AS source_lang,
  CASE e.k % 6 WHEN 0 THEN 'reddit_public' WHEN 1 THEN 'reliefweb_ocha' ELSE 'gdelt_gkg' END AS attribution_method,
  e.k % 11 = 0 AS is_state_media,
  CASE WHEN e.k % 4 = 0 THEN NULL WHEN e.k % 4 = 1 THEN concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) ELSE 'N00' END AS source_origin_country,
  CASE WHEN e.k % 7 = 6 THEN NULL ELSE concat('frame_', CAST(e.k % 7 AS STRING)) END AS nlp_framing,
  CASE WHEN e.k % 3 = 0 THEN (e.value - CAST(50 AS DOUBLE)) / CAST(20 AS DOUBLE) END AS nlp_sentiment,
  CAST(0.5 AS DOUBLE) + (e.k % 5) / CAST(10 AS DOUBLE) AS geo_confidence,
  e.k % 9 < 3 AS is_crisis, CAST(e.k AS DOUBLE) / CAST(100 AS DOUBLE) AS crisis_score,
  CASE e.k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, lower(e.event_type) AS event_type
FROM (""" + EVENTS + """) e JOIN {customer} c ON e.user_id = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""

COUNTRIES = """
SELECT concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS country_code, n_name AS name, concat('R', CAST(n_regionkey AS STRING)) AS region,
  CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS longitude FROM {nation}"""

GEO_EVENTS = """
SELECT e.event_id, e.ts, concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS country_code, e.k % 4 + 1 AS quad_class,
  CAST(e.k - 50 AS DOUBLE) / CAST(5 AS DOUBLE) AS goldstein, e.k % 13 AS num_mentions, concat('0', CAST(e.k % 9 AS STRING)) AS root_code,
  concat('ACTOR', CAST(e.k % 6 AS STRING)) AS actor1, concat('ACTOR', CAST(e.event_id % 4 AS STRING)) AS actor2,
  CAST(c.c_nationkey * 5 - 60 AS DOUBLE) AS latitude, CAST(c.c_nationkey * 14 - 170 AS DOUBLE) AS longitude
FROM (""" + EVENTS + """) e JOIN {customer} c ON e.user_id = c.c_custkey"""

TRENDS = """
SELECT concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS country_code, lower(e.event_type) AS keyword, e.ts, e.k % 20 + 1 AS rank, e.k * 1000 AS volume
FROM (""" + EVENTS + """) e JOIN {customer} c ON e.user_id = c.c_custkey WHERE e.k % 3 = 0"""

PAGEVIEWS = """
SELECT CAST(e.ts AS DATE) AS day, concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS country_code, concat(upper(e.event_type), '_', CAST(e.k % 10 AS STRING)) AS title, CAST(sum(e.k) AS BIGINT) AS views
FROM (""" + EVENTS + """) e JOIN {customer} c ON e.user_id = c.c_custkey GROUP BY 1, 2, 3"""

VIEWS = {"signals": SIGNALS, "countries": COUNTRIES, "geo_events": GEO_EVENTS, "trends": TRENDS, "pageviews": PAGEVIEWS}


def exactly_rounded(sql: str) -> str:
    """``round(x, 6)`` by way of exact decimals of ten places, as the operators round."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, commas, end = 0, [], start + 5
        for end in range(start + 5, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if sql[end] == "," and depth == 1:
                commas.append(end)
            if depth == 0:
                break
        inner, places = sql[start + 6 : commas[-1] if commas else end], sql[commas[-1] + 1 : end].strip() if commas else ""
        inner = exactly_rounded(inner)
        out += sql[at:start] + (f"CAST(round(TRY_CAST({inner} AS DECIMAL(28, 10)), 6) AS DOUBLE)" if places == "6" else f"round({inner}{', ' + places if places else ''})")
        at = end + 1
    return out + sql[at:]


def oracle(body: str) -> str:
    """SQL for DuckDB: the views that ``body`` names, and ``body``, which starts with SELECT or with ", x AS (...)"."""
    names = {"events": "events", "customer": "customer", "nation": "nation"}
    used = [v for v in VIEWS if v in body]
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**DUCK, **names)})" for v in used)
    body = exactly_rounded(body.replace("{AS_OF}", f"TIMESTAMP '{AS_OF}'").strip())
    if not views:
        return body if not body.startswith(",") else "WITH " + body[1:]
    return f"WITH {views} {body}"


class Tables:
    """The driver's tables and the views over them, for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        return self.spark.sql(VIEWS[name].format(**SPARK, events="{events}", customer="{customer}", nation="{nation}"), **{t: self.raw(t) for t in ("events", "customer", "nation") if "{" + t + "}" in VIEWS[name]})

    signals = cached_property(lambda self: self._view("signals"))
    countries = cached_property(lambda self: self._view("countries"))
    geo_events = cached_property(lambda self: self._view("geo_events"))
    trends = cached_property(lambda self: self._view("trends"))
    pageviews = cached_property(lambda self: self._view("pageviews"))
