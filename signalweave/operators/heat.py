"""Country heat, anomalies against baselines, and indicators of sources and volume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from . import rollups as R
from .rollups import r, two


def country_heat(S: DataFrame, as_of: str, hours: int = 24, baseline_days: int = 14, least_origins: int = 50, least_framed: int = 25) -> DataFrame:
    """Each country's heat: volume against its baseline, surprise of its themes, diversity of families, local voice, variety of
    frames, confidence of places, less duplication. Every part is 0 to 1 and has a default where there is too little to tell.

    The signals are read once: a row becomes (kind, value) pairs that are counted by country; a theme's count in all countries and the
    total of all themes are sums over these counts. Of a divergence p * ln(p / q) with sums n of a country and m of all, what is left to
    sum up are n * ln(n) and n * ln(m).
    """
    now, before = exprs.in_window(F.col("ts"), as_of, hours), exprs.in_window(F.col("ts"), as_of, baseline_days * 24, 24)
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    lower = F.transform(F.when(F.size("themes") > 0, F.col("themes")).otherwise(F.array(F.lit(None).cast("string"))), lambda x: pair("theme", F.coalesce(F.lower(x), F.lit("__none__"))))
    placed = F.col("country_code").isNotNull()
    window = F.array(pair("row", F.lit("")), pair("family", F.col("source_family")), pair("frame", F.col("nlp_framing")), pair("headline", F.lower("headline")))
    pairs = F.concat(F.when(now, lower).otherwise(none), F.when(now & placed, window).otherwise(none), F.when(before & placed, F.array(pair("day", R.day()))).otherwise(none))
    rows = S.where(now | before).select("country_code", "source_origin_country", "geo_confidence", F.explode(pairs).alias("p")).select("*", "p.kind", "p.value").where("value is not null")
    of_row, own = F.col("kind") == "row", F.col("source_origin_country")
    counts = rows.groupBy("country_code", "kind", "value").agg(
        F.count("*").alias("n"), F.sum(F.when(of_row, F.nullif("geo_confidence", F.lit(0.0)))).alias("geo"), F.count(F.when(of_row, F.nullif("geo_confidence", F.lit(0.0)))).alias("geo_n"),
        F.count(F.when(of_row, own)).alias("known"), F.count_if(of_row & (own == F.col("country_code"))).alias("own"),
    )
    counts = counts.withColumn("m", F.sum("n").over(Window.partitionBy("kind", "value")))
    of = lambda kind, x=F.col("n"): F.when(F.col("kind") == kind, x)
    total = lambda kind, x=F.col("n"): F.sum(of(kind, x))
    nlogn = F.col("n") * F.log("n")
    entropy = lambda kind: F.greatest(F.log(total(kind)) - total(kind, nlogn) / total(kind), F.lit(0.0))
    kinds = lambda kind: F.count(of(kind))
    rows = counts.groupBy("country_code").agg(
        total("row").alias("volume_now"), F.try_divide(F.sum("geo"), F.sum("geo_n")).alias("geo"), F.sum("known").alias("known"), F.try_divide(F.sum("own"), F.sum("known")).alias("local"),
        (1 - F.try_divide(kinds("headline"), total("headline"))).alias("dup"), F.avg(of("day")).alias("base"), F.nullif(F.stddev_pop(of("day")), F.lit(0.0)).alias("sigma"),
        F.when(kinds("family") > 1, entropy("family") / F.log(kinds("family"))).when(kinds("family") == 1, 0.0).alias("families"), entropy("frame").alias("frame_h"), F.coalesce(total("frame"), F.lit(0)).alias("framed"),
        total("theme").alias("themes"), (total("theme", nlogn) - total("theme", F.col("n") * F.log("m"))).alias("logs"),
    )
    every = F.sum("themes").over(Window.partitionBy())  # one row a country
    rows = rows.withColumn("kl", F.col("logs") / F.col("themes") - F.log("themes") + F.log(every)).where(F.col("volume_now").isNotNull())
    z = (F.col("volume_now") / (hours / 24.0) - F.col("base")) / F.col("sigma")
    half = F.lit(0.5)
    parts = {
        "velocity": F.coalesce(1.0 / (1.0 + F.exp(-z / 3.0)), half),
        "surprise": F.coalesce(F.least(F.greatest("kl", F.lit(0.0)) / 2.0, F.lit(1.0)), F.lit(0.0)),
        "diversity": F.coalesce("families", F.lit(0.0)),
        "local_voice": F.coalesce(F.when(F.col("known") >= least_origins, F.col("local")), half),
        "polyphony": F.coalesce(F.when(F.col("framed") >= least_framed, F.col("frame_h") / F.log(F.lit(6.0))), half),
        "geo_confidence": F.coalesce("geo", half),
        "duplication": F.coalesce(F.least(F.greatest("dup", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)),
    }
    weights = {"velocity": 0.25, "surprise": 0.20, "diversity": 0.15, "local_voice": 0.15, "polyphony": 0.10, "geo_confidence": 0.10, "duplication": -0.05}
    heat = reduce(lambda a, b: a + b, [parts[k] * w for k, w in weights.items()])
    return rows.select("country_code", "volume_now", r(F.col("base")).alias("baseline_daily"), *[r(v).alias(k) for k, v in parts.items()], r(heat).alias("heat"))


def _against_baseline(n: Column, mean: Column, sd: Column, hours: float) -> dict[str, Column]:
    """Multiplier and z score against a daily baseline scaled to the window; without a deviation it is 0.3 of the mean."""
    scale = hours / 24.0
    return {
        "multiplier": two(F.try_divide(n.cast("double"), mean * scale)),
        "zscore": two(F.try_divide(n - mean * scale, F.coalesce(sd, mean * 0.3) * scale)),
    }


def anomaly_level(multiplier: Column, z: Column) -> Column:
    return (
        F.when(multiplier.isNull() | z.isNull(), "normal")
        .when((z > 4) & (multiplier > 3), "critical")
        .when((z > 2.5) | (multiplier > 2), "elevated")
        .when((z > 1.5) & (multiplier > 1.5), "notable")
        .otherwise("normal")
    )


def country_baseline(S: DataFrame, as_of: str, days: int = 7, skip_hours: float = 0) -> DataFrame:
    """Mean and deviation of daily rows a country; without a deviation 0.3 of the mean."""
    daily = S.where(exprs.in_window(F.col("ts"), as_of, days * 24, skip_hours)).groupBy("country_code", R.day().alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy("country_code").agg(F.count("*").alias("days"), r(F.avg("n")).alias("avg_daily"), r(F.coalesce(F.nullif(F.stddev_samp("n"), F.lit(0.0)), 0.3 * F.avg("n"))).alias("sd_daily"))


def country_anomalies(hourly: DataFrame, countries: DataFrame, as_of: str, hours: int = 24, least: int = 5, days: int = 8, limit: int | None = None) -> DataFrame:
    """Countries' rows in the window against the days before it, from the hourly rollup, with a level each."""
    recent = hourly.where(exprs.in_window(F.col("hour"), as_of, hours)).groupBy("country_code").agg(F.sum("signal_count").alias("current_count")).where(F.col("current_count") >= least)
    daily = hourly.where(exprs.in_window(F.col("hour"), as_of, days * 24, hours)).groupBy("country_code", R.day("hour").alias("day")).agg(F.sum("signal_count").alias("n"))
    base = daily.groupBy("country_code").agg(F.count("*").alias("days_observed"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    scored = recent.join(base, "country_code").join(countries.select("country_code", "name"), "country_code", "left")
    made = scored.withColumns(_against_baseline(F.col("current_count"), F.col("mean"), F.col("sd"), hours))
    out = made.select("country_code", F.coalesce("name", "country_code").alias("country_name"), "current_count", r(F.col("mean")).alias("baseline_avg"), "days_observed", "multiplier", "zscore", anomaly_level(F.col("multiplier"), F.col("zscore")).alias("level"))
    return out if limit is None else out.orderBy(F.desc_nulls_last("zscore"), "country_code").limit(limit)


def anomaly_lists(anomalies: DataFrame, limit: int = 10, misses: int = 3) -> dict[str, DataFrame]:
    """Of the 2 * ``limit`` countries with the largest z: those that are not normal, at most ``limit``, and of the others the first few over their baseline."""
    order = [F.desc_nulls_last("zscore"), F.asc("country_code")]
    top = anomalies.orderBy(*order).limit(2 * limit)
    return {"anomalies": top.where("level <> 'normal'").orderBy(*order).limit(limit), "near_misses": top.where("level = 'normal' and multiplier > 1").orderBy(*order).limit(misses)}


def system_totals(hourly: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Active countries and rows of the last hours, from the hourly rollup."""
    return hourly.where(exprs.in_window(F.col("hour"), as_of, hours)).agg(F.countDistinct("country_code").alias("active_countries"), F.coalesce(F.sum("signal_count"), F.lit(0)).alias("total_signals"))


def overall_severity(anomalies: DataFrame) -> DataFrame:
    worst = F.max(F.when(F.col("level") == "critical", 3).when(F.col("level") == "elevated", 2).when(F.col("level") == "notable", 1).otherwise(0))
    return anomalies.agg(F.element_at(F.array(*map(F.lit, ("normal", "notable", "elevated", "critical"))), F.coalesce(worst, F.lit(0)) + 1).alias("overall"), F.count_if(F.col("level") != "normal").alias("anomalies"))


def theme_anomalies(S: DataFrame, daily: DataFrame, as_of: str, hours: int = 24, least: int = 10, days: int = 7, z_min: float = 1.5) -> DataFrame:
    """Themes' rows in the window against their daily rollup, those over ``z_min``."""
    recent = R.exploded(S.where(exprs.in_window(F.col("ts"), as_of, hours))).groupBy("theme").agg(F.count("*").alias("current_count")).where(F.col("current_count") >= least)
    base = daily.where(F.col("day") > F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")).groupBy("theme").agg(F.avg("signal_count").alias("mean"), F.stddev_samp("signal_count").alias("sd"))
    rows = recent.join(base, "theme")
    z = F.try_divide(F.col("current_count") - F.col("mean") * (hours / 24.0), F.coalesce("sd", F.col("mean") * 0.3) * (hours / 24.0))
    return rows.where(z > z_min).withColumns(_against_baseline(F.col("current_count"), F.col("mean"), F.col("sd"), hours)).select("theme", "current_count", r(F.col("mean")).alias("baseline_avg"), "multiplier", "zscore")


#: Hours of the named ranges of the map.
RANGES = {"24h": 24, "1w": 168, "1m": 720, "3m": 2160, "record": 8760}


def country_nodes(
    S: DataFrame, hourly: DataFrame, daily: DataFrame, countries: DataFrame, baseline: DataFrame, as_of: str, hours: int = 24, range_name: str | None = None, focus: tuple[str, str] | None = None, only: list[str] | None = None, limit: int = 217
) -> DataFrame:
    """Countries as map nodes, the largest ``limit`` by rows: intensity (rows over the largest), heat, level, tone over 10, outlets.

    With a focus (kind, value) the rows themselves are counted, of 168 hours at most, and 80 countries at most; else up to 168
    hours come from the hourly rollup and longer windows from the daily one, whose tones are averaged and outlets summed as they
    are. ``only`` then picks countries. Heat is z / 3 against the daily baseline, from 0 to 1; with a focus, without a baseline
    or without deviation it is the intensity, and the level normal. A country without a place has no node.
    """
    hours = RANGES.get(range_name, hours) if range_name else hours
    if focus:
        kind, value = focus
        rows = S.where(exprs.in_window(F.col("ts"), as_of, min(hours, 168)) & exprs.focus(kind, value.upper() if kind in ("theme", "country") else value))
        now = rows.groupBy("country_code").agg(F.count("*").alias("signal_count"), F.avg("sentiment").alias("t"), F.countDistinct("source_name").alias("sources"))
        limit = min(limit, 80)
    else:
        at, rollup, back = ("day", daily, hours // 24 * 24) if hours > 168 else ("hour", hourly, hours)
        now = rollup.where(exprs.in_window(F.col(at), as_of, back)).groupBy("country_code").agg(F.sum("signal_count").alias("signal_count"), F.avg("avg_sentiment").alias("t"), F.sum("sources").alias("sources"))
    top = now.orderBy(F.desc("signal_count"), "country_code").limit(min(limit, 217))
    if only:
        top = top.where(F.col("country_code").isin([c.strip().upper() for c in only]))
    largest = top.agg(F.max("signal_count").alias("largest"))
    # one row, and at most ``limit`` rows
    rows = top.join(F.broadcast(largest)).join(countries.select("country_code", "name", "latitude", "longitude"), "country_code", "left").join(baseline, "country_code", "left")
    n, scale = F.col("signal_count"), hours / 24.0
    intensity = F.try_divide(n.cast("double"), F.col("largest"))
    sd = F.coalesce(F.nullif("sd_daily", F.lit(0.0)), F.nullif(0.3 * F.col("avg_daily"), F.lit(0.0)), F.lit(1.0))
    told = F.lit(focus is None) & F.col("avg_daily").isNotNull()
    z = (n - F.col("avg_daily") * scale) / (sd * scale)
    multiplier = F.coalesce(F.try_divide(n.cast("double"), F.nullif(F.col("avg_daily") * scale, F.lit(0.0))), F.lit(1.0))
    return rows.where("latitude is not null and longitude is not null").select(
        "country_code", F.coalesce("name", "country_code").alias("name"), "latitude", "longitude", "signal_count", r(F.coalesce("t", F.lit(0.0)) / 10).alias("tone"), "sources", r(intensity).alias("intensity"),
        r(F.when(told, F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / 3.0))).otherwise(intensity)).alias("heat"), F.when(told, anomaly_level(multiplier, z)).otherwise("normal").alias("level"),
    )


def source_diversity(S: DataFrame, key: str) -> DataFrame:
    """0 to 100: half for the number of outlets (21 or more give all), half for how evenly they report."""
    spread = R.entropy(S, [key], "source_name")
    score = F.least(F.lit(50.0), 50.0 * F.log(F.col("kinds") + 1) / F.log(F.lit(21.0))) + 50.0 * F.col("evenness")
    return spread.select(key, F.col("kinds").alias("outlets"), r(score).alias("diversity"))


def source_quality(S: DataFrame, key: str, allowed: list[str] = fixed.TRUSTED_DOMAINS, denied: list[str] = fixed.AGGREGATOR_DOMAINS) -> DataFrame:
    """30, plus 10 an allowed domain up to 70, less 20 a denied one; 0 to 100."""
    domains = S.select(key, exprs.domain(F.col("source_url")).alias("d")).distinct()
    a, d = F.count_if(F.col("d").isin(allowed)), F.count_if(F.col("d").isin(denied))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 30 + F.least(F.lit(70), 10 * a) - 20 * d))
    return domains.groupBy(key).agg(F.count("*").alias("domains"), score.cast("int").alias("quality"))


def volume_level(z: Column) -> Column:
    return F.when(z.isNull(), "unknown").when(z > 3, "exceptional").when(z > 2, "high").when(z > 1, "elevated").when(z < -1, "low").otherwise("normal")


def normalized_volume(S: DataFrame, key: str, as_of: str, hours: int = 24, days: int = 7) -> DataFrame:
    """Rows in the window against the daily mean before it, scaled to the window: multiplier and z to two places, level by z.

    Without a baseline both are null and the level is unknown; without deviation z is 3, 0 or -3.
    """
    now = S.where(exprs.in_window(F.col("ts"), as_of, hours)).groupBy(key).agg(F.count("*").alias("current"))
    daily = S.where(exprs.in_window(F.col("ts"), as_of, days * 24 + hours, hours)).groupBy(key, R.day().alias("day")).agg(F.count("*").alias("n"))
    base = daily.groupBy(key).agg(F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"))
    rows = now.join(base, key, "left")
    per_day = F.col("current") / (hours / 24.0)
    gap = per_day - F.col("mean")
    z = F.when(F.col("sd") > 0, gap / F.nullif("sd", F.lit(0.0))).when(gap > 0, 3.0).when(gap < 0, -3.0).when(gap == 0, 0.0)
    return rows.select(key, "current", F.round(F.col("mean").try_cast("decimal(24,8)"), 1).cast("double").alias("baseline"), two(F.try_divide(per_day, F.col("mean"))).alias("multiplier"), two(z).alias("z"), volume_level(z).alias("level"))


def country_indicators(S: DataFrame, as_of: str, hours: int, allowed: list[str] = fixed.TRUSTED_DOMAINS, denied: list[str] = fixed.AGGREGATOR_DOMAINS) -> DataFrame:
    now = S.where(exprs.in_window(F.col("ts"), as_of, hours) & F.col("country_code").isNotNull())
    joined = source_diversity(now, "country_code").join(source_quality(now, "country_code", allowed, denied), "country_code")
    return joined.join(normalized_volume(S, "country_code", as_of, hours), "country_code")
