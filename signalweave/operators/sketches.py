"""Distinct counts that merge: sketches in rollups, so that days come from hours, and hours from micro-batches, without reading signals again.

Exact distinct counts do not add up over hours. A sketch (of 2^``size`` registers, a relative error of about 1.04 / sqrt(2^size) for large
numbers, next to none below a few hundred) does: the union of sketches is the sketch of all. Exact forms stay in ``rollups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import hour, r

SIZE = 12
DISTINCT = {"sources": "source_name", "countries": "country_code", "urls": "source_url"}


def _measures(distinct: dict[str, str], size: int) -> list:
    sums = [F.count("*").alias("signal_count"), F.sum("sentiment").alias("sentiment_sum"), F.count("sentiment").alias("sentiment_n")]
    return sums + [F.hll_sketch_agg(c, size).alias(n) for n, c in distinct.items()]


def sketched_hourly(S: DataFrame, keys: list[str], distinct: dict[str, str] = DISTINCT, size: int = SIZE) -> DataFrame:
    """Rows an hour and key with sums and, for each of ``distinct`` (name to column), a sketch. Null values are in no sketch."""
    return S.groupBy(hour().alias("hour"), *keys).agg(*_measures(distinct, size))


def stream_sketched(S: DataFrame, keys: list[str], late: str = "2 hours", distinct: dict[str, str] = DISTINCT, size: int = SIZE) -> DataFrame:
    """The same table from a stream; its state holds one sketch an hour, key and column, whatever the number of rows."""
    rows = S.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), *keys).agg(*_measures(distinct, size))
    return rows.select(F.col("w.start").alias("hour"), *[c for c in rows.columns if c != "w"])


def merged(rows: DataFrame, keys: list[str], unit: str = "day", distinct: dict[str, str] = DISTINCT) -> DataFrame:
    """Hours, or parts of them, as days or any longer ``unit``: a table of the same kind, by the start of the unit."""
    sums = [F.sum(c).alias(c) for c in ("signal_count", "sentiment_sum", "sentiment_n")]
    per = rows.groupBy(F.date_trunc(unit, "hour").alias("hour"), *keys)
    return per.agg(*sums, *[F.hll_union_agg(n).alias(n) for n in distinct])


def estimated(rows: DataFrame, distinct: dict[str, str] = DISTINCT) -> DataFrame:
    """Mean tone and numbers in place of sums and sketches."""
    kept = [c for c in rows.columns if c not in (*distinct, "sentiment_sum", "sentiment_n")]
    return rows.select(*kept, r(F.try_divide("sentiment_sum", "sentiment_n")).alias("avg_sentiment"), *[F.hll_sketch_estimate(n).alias(n) for n in distinct])
