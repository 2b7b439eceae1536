"""Events, conflicts, searches, page views, crises, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, exprs, fixed
from .rollups import containing, r, two


def reranked(pages: DataFrame, n: int, by: str = "views", key: str = "title") -> DataFrame:
    """The first n rows with new ranks from 1. The rank runs over at most n rows."""
    top = pages.orderBy(F.desc(by), key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))


def conflict_markers(conflicts: DataFrame, events: DataFrame, as_of: str, days: int = 3, limit: int = 200, goldstein: float = -3.0) -> DataFrame:
    """Verified conflicts of the last days; only if there are none, material conflicts among the events that have a place.

    conflicts: id, ts, actor1, actor2, country_code, latitude, longitude, fatalities. events: the event view.
    """
    columns = ["id", "ts", "actor1", "actor2", "country_code", "latitude", "longitude"]
    verified = conflicts.where(exprs.in_window(F.col("ts"), as_of, days * 24)).select(*columns, "fatalities", F.lit("verified").alias("severity"), F.lit(0).cast("long").alias("mentions"))
    inferred = events.where(exprs.in_window(F.col("ts"), as_of, days * 24) & (F.col("quad_class") == 4) & (F.col("goldstein") < goldstein) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    inferred = inferred.select(F.col("event_id").cast("string").alias("id"), *columns[1:], F.lit(0).cast("long").alias("fatalities"), F.lit("inferred").alias("severity"), F.col("num_mentions").cast("long").alias("mentions"))
    none = verified.agg((F.count("*") == 0).alias("none"))  # one row
    both = verified.unionByName(inferred.join(F.broadcast(none)).where("none").drop("none"))
    return both.orderBy(F.desc("ts"), F.desc("mentions"), "id").limit(limit)


def list_conflicts(conflicts: DataFrame, country: str, limit: int = 100) -> DataFrame:
    return conflicts.where(F.lower("country_code").contains(country.lower())).orderBy(F.desc("ts"), "id").limit(limit)


def list_events(events: DataFrame, as_of: str, hours: float, country: str | None = None, limit: int = 100) -> DataFrame:
    rows = events.where(exprs.in_window(F.col("ts"), as_of, hours))
    rows = rows if country is None else rows.where(F.col("country_code") == country)
    return rows.orderBy(F.desc("ts"), "event_id").limit(limit)


def coded_label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, else of its first three, else of its first two letters, else the code."""
    return F.coalesce(*[dims.lookup(labels, x) for x in (code, F.substring(code, 1, 3), F.substring(code, 1, 2))], code)


def event_label(code: Column, labels: dict[str, str] = fixed.EVENT_CODE_LABELS) -> Column:
    """The label of an event code of three digits or more (zeros are put before shorter ones), else of its first digits, else ``Action`` and the code."""
    whole = F.when(F.length(code) < 3, F.lpad(code, 3, "0")).otherwise(code)
    return F.coalesce(*[dims.lookup(labels, x) for x in (whole, F.substring(whole, 1, 3), F.substring(whole, 1, 2))], F.concat(F.lit("Action "), whole))


def event_clusters(events: DataFrame, as_of: str, hours: float, least: int = 3) -> DataFrame:
    """Events by country and class: number, Goldstein, mentions, centre, kinds, most frequent actors (ties: the smaller)."""
    rows = events.where(exprs.in_window(F.col("ts"), as_of, hours) & F.col("country_code").isNotNull())
    keys = ["country_code", "quad_class"]
    base = rows.groupBy(*keys).agg(F.count("*").alias("event_count"), two(F.avg("goldstein")).alias("avg_goldstein"), F.sum("num_mentions").alias("mentions"), r(F.avg("latitude")).alias("lat"), r(F.avg("longitude")).alias("lon"), F.array_join(F.array_sort(F.collect_set("root_code")), ",").alias("root_codes"))
    for a in ("actor1", "actor2"):
        counts = rows.where(F.col(a).isNotNull()).groupBy(*keys, a).agg(F.count("*").alias("k"))
        base = base.join(counts.groupBy(*keys).agg(F.min_by(a, F.struct(-F.col("k"), a)).alias(f"top_{a}")), keys, "left")
    label = dims.lookup({str(k): v for k, v in fixed.QUAD_CLASS_LABELS.items()}, F.col("quad_class").cast("string"))
    return base.where(F.col("event_count") >= least).withColumn("label", label).withColumn("intensity", exprs.conflict_intensity(F.col("avg_goldstein")))


def trending_searches(trends: DataFrame, country: str | None = None, limit: int = 20) -> DataFrame:
    """A country's searches by rank; for all countries, in how many a keyword is and its best rank."""
    if country is not None:
        return trends.where(F.col("country_code") == country).groupBy("keyword").agg(F.min("rank").alias("rank"), F.max("volume").alias("volume")).orderBy("rank", "keyword").limit(limit)
    return trends.groupBy("keyword").agg(F.countDistinct("country_code").alias("countries"), F.min("rank").alias("best_rank")).orderBy(F.desc("countries"), "best_rank", "keyword").limit(limit)


def text_match(words: DataFrame, texts: DataFrame, text: str, counted: str) -> DataFrame:
    """Texts that contain any of the words, with the words found and the sum of ``counted``. Words: a column ``word``."""
    found = texts.groupBy(F.lower(text).alias("t")).agg(F.sum(counted).alias("total"))
    hits = containing(found, "t", words.select("word").distinct(), "word")
    return hits.groupBy("t").agg(F.first("total").alias("total"), F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"))


def top_pages(pageviews: DataFrame, country: str | None = None, limit: int = 25) -> DataFrame:
    rows = pageviews if country is None else pageviews.where(F.col("country_code") == country)
    return reranked(rows.groupBy("title").agg(F.sum("views").alias("views")), limit)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "high", 2).when(severity == "medium", 3).otherwise(4)


def crisis_signals(S: DataFrame, severity: str | None = None, event_type: str | None = None, limit: int = 100) -> DataFrame:
    rows = S.where("is_crisis")
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    rows = rows if event_type is None else rows.where(F.col("event_type") == event_type)
    return rows.orderBy(severity_rank(F.col("severity")), F.desc("ts"), "signal_id").limit(limit)


def crisis_summary(S: DataFrame, as_of: str, hours: float) -> dict[str, DataFrame]:
    rows = S.where(exprs.in_window(F.col("ts"), as_of, hours))
    crises = rows.where("is_crisis")
    by = lambda c: crises.groupBy(c).agg(F.count("*").alias("n"), r(F.avg("crisis_score")).alias("score"))
    return {
        "totals": rows.agg(F.count("*").alias("signals"), F.count_if("is_crisis").alias("crises"), F.countDistinct(F.when(F.col("is_crisis"), F.col("country_code"))).alias("countries")),
        "severity": by("severity"),
        "types": by("event_type"),
        "countries": by("country_code").orderBy(F.desc("n"), "country_code").limit(10),
    }


def signal_velocity(S: DataFrame, as_of: str, minutes: float = 1.0) -> DataFrame:
    n = lambda a, b: F.count_if(exprs.in_window(F.col("ts"), as_of, a / 60.0, b / 60.0))
    return S.agg(n(minutes, 0).alias("last"), n(2 * minutes, minutes).alias("previous")).withColumn("change", F.col("last") - F.col("previous"))


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points inside boxes (id, lat_min, lat_max, lon_min, lon_max).

    Boxes and points meet by equal ten-degree cells; the ranges are compared only there.
    """
    cell = lambda c: F.floor(c / 10.0)
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a)), cell(F.col(b))))
    cells = boxes.select("*", span("lat_min", "lat_max").alias("x")).select("*", span("lon_min", "lon_max").alias("y"))
    rows = points.withColumn("x", cell(F.col("latitude"))).withColumn("y", cell(F.col("longitude")))
    inside = F.col("latitude").between(F.col("lat_min"), F.col("lat_max")) & F.col("longitude").between(F.col("lon_min"), F.col("lon_max"))
    return rows.join(cells, ["x", "y"]).where(inside).drop("x", "y", "lat_min", "lat_max", "lon_min", "lon_max")


def nearest_chokepoint(points: DataFrame, chokepoints: list[tuple] = dims.CHOKEPOINTS) -> DataFrame:
    """The first strait, in order, whose radius a point is within; null if none. A short ``when`` chain, no join."""
    out = None
    for name, lat, lon, km in chokepoints:
        near = exprs.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) < km
        out = (F if out is None else out).when(near, name)
    return points.withColumn("chokepoint", out)


def aircraft_snapshot(positions: DataFrame, military: list[str] = fixed.MILITARY_PREFIXES, government: list[str] = fixed.GOVERNMENT_PREFIXES, hex_ranges: list[str] = fixed.MILITARY_ADDRESSES, limit: int = 2000) -> DataFrame:
    """Flying aircraft with valid places, classified, the highest first."""
    valid = ~F.coalesce("on_ground", F.lit(False)) & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    kind = exprs.aircraft_class(F.col("callsign"), F.col("icao24"), military, government, hex_ranges)
    return positions.where(valid).withColumn("kind", kind).orderBy(F.desc_nulls_last("altitude"), "icao24").limit(limit)


def near_or_high(aircraft: DataFrame, lat: float, lon: float, km: float = 700.0, altitude: float = 9000.0) -> DataFrame:
    return aircraft.where((exprs.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= km) | (F.col("altitude") > altitude))
