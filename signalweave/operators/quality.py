"""Retention, data quality, freshness, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import rollups as R
from .rollups import r


def prune_unenriched(S: DataFrame, as_of: str, days: int, enriched: str = "nlp_sentiment") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, how many go by family): old rows that no model has seen go."""
    gone = (F.col("ts") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")) & F.col(enriched).isNull()
    return S.where(~gone), S.where(gone).groupBy("source_family").agg(F.count("*").alias("n"))


def age_distribution(S: DataFrame, as_of: str, bounds: tuple = (7, 30, 90)) -> DataFrame:
    days = (F.to_timestamp(F.lit(as_of)).cast("double") - F.col("ts").cast("double")) / 86400.0
    names = [f"{a}-{b}d" for a, b in zip((0, *bounds[:-1]), bounds)]
    bucket = reduce(lambda w, x: w.when(days <= x[1], x[0]), zip(names[1:], bounds[1:]), F.when(days <= bounds[0], names[0])).otherwise(f">{bounds[-1]}d")
    return R.share_of_total(S.withColumn("age", bucket), "age")


def quality_report(S: DataFrame, as_of: str) -> dict[str, DataFrame]:
    aggregator = F.avg((F.col("source_family") == "gdelt").cast("double"))
    return {
        "volume": S.agg(F.count("*").alias("n"), R.two(100.0 * (1 - F.countDistinct("source_url") / F.count("source_url"))).alias("duplicate_pct")),
        "sources": R.share_of_total(S, "source_name").orderBy(F.desc("n"), "source_name").limit(10),
        "themes": R.exploded(S).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(10),
        "aggregators": S.agg(R.two(100.0 * aggregator).alias("pct")),
        "freshness": freshness(S, as_of),
    }


def freshness(S: DataFrame, as_of: str, healthy: float = 30.0, low: float = 120.0) -> DataFrame:
    minutes = (F.to_timestamp(F.lit(as_of)).cast("double") - F.max("ts").cast("double")) / 60.0
    rows = S.agg(F.max("ts").alias("newest"), R.two(minutes).alias("lag_minutes"))
    return rows.withColumn("status", F.when(F.col("lag_minutes") <= healthy, "healthy").when(F.col("lag_minutes") <= low, "low").otherwise("stalled"))


def system_stats(S: DataFrame, as_of: str) -> DataFrame:
    n = lambda h: F.count_if(exprs.in_window(F.col("ts"), as_of, h))
    return S.agg(n(1).alias("n_1h"), n(24).alias("n_24h"), n(168).alias("n_7d"), F.countDistinct("country_code").alias("countries"), F.countDistinct("source_name").alias("sources"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def signal_rules() -> dict[str, Column]:
    """What a valid signal never does, by name."""
    c = F.col
    return {
        "latitude_range": ~c("latitude").between(-90, 90),
        "longitude_range": ~c("longitude").between(-180, 180),
        "coordinate_pair": c("latitude").isNull() != c("longitude").isNull(),
        "confidence_range": ~c("geo_confidence").between(0, 1),
        "sentiment_range": ~c("sentiment").between(-100, 100),
        "severity_name": ~c("severity").isin("critical", "high", "medium", "low"),
        "no_country": c("country_code").isNull(),
    }


def grid_rules() -> dict[str, Column]:
    return {"intensity_range": ~F.col("intensity").between(0, 1), "no_cell": F.col("q").isNull() | F.col("r").isNull(), "no_intensity": F.col("intensity").isNull()}


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each broken rule, in one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), n) for n, v in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in tables.items()])


def nlp_calibration(corrections: DataFrame, S: DataFrame) -> DataFrame:
    """By language and method: corrections, mean change of sentiment, share of changed framings (null counts as unchanged)."""
    rows = corrections.join(S.select("signal_id", "source_lang", "nlp_method"), "signal_id")
    delta = F.abs(F.col("corrected_sentiment") - F.col("original_sentiment"))
    changed = F.when(F.col("corrected_framing") != F.col("original_framing"), 1.0).otherwise(0.0)
    return rows.groupBy(F.coalesce("source_lang", F.lit("unknown")).alias("source_lang"), "nlp_method").agg(F.count("*").alias("corrections"), r(F.avg(delta)).alias("avg_delta"), r(F.avg(changed)).alias("framing_rate"))


def low_volume_countries(S: DataFrame, as_of: str, days: int = 7, below: int = 1400) -> DataFrame:
    return S.where(exprs.in_window(F.col("ts"), as_of, days * 24)).groupBy("country_code").agg(F.count("*").alias("n")).where(F.col("n") < below)


def explain_hotspot(S: DataFrame, country: str) -> dict[str, DataFrame]:
    """A country's totals, five themes, ten entities, five outlets."""
    rows = S.where(F.col("country_code") == country)
    top = lambda df, key, n: df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
    return {
        "totals": rows.agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone"), F.countDistinct("source_name").alias("sources")),
        "themes": top(R.exploded(rows), "theme", 5),
        "entities": top(R.exploded(rows, "persons", "person"), "person", 10),
        "sources": top(rows, "source_name", 5),
    }
