"""Tables: appends of what is new, merges, bridges, exports, backfills, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import first_per


def new_rows(new: DataFrame, existing: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Rows whose key is not there yet, the first of each key; null keys are always new."""
    keyed = first_per(new, [F.col(key)], order or [F.asc(c) for c in new.columns if c != key][:2] or [F.asc(key)])
    fresh = keyed.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*new.columns)
    return fresh.unionByName(new.where(F.col(key).isNull()))


def append_new(new: DataFrame, path: str, key: str, partition: str | None = None) -> None:
    """Appends rows with new keys to a Parquet table, which may not exist yet."""
    spark = new.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = new.limit(0)
    writer = new_rows(new, existing, key).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """old and new by key as one: per column the ``greatest``, the ``new`` value if there is one, or the ``old`` one first."""
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    pick = {"greatest": lambda c: F.greatest(f"o.{c}", f"n.{c}"), "new": lambda c: F.coalesce(f"n.{c}", f"o.{c}"), "old": lambda c: F.coalesce(f"o.{c}", f"n.{c}")}
    return joined.select(*keys, *[pick[rules.get(c, "new")](c).alias(c) for c in old.columns if c not in keys])


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Writes the partitions that df has rows of, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_bridges(S: DataFrame) -> dict[str, DataFrame]:
    """Signals as a table without arrays and tables of themes and entities."""
    people = S.select("signal_id", F.explode("persons").alias("name"), F.lit("person").alias("type"))
    return {"signals": S.drop("themes", "persons"), "themes": S.select("signal_id", F.explode("themes").alias("theme")), "entities": people}


def from_bridges(parts: dict[str, DataFrame], low: str, high: str) -> DataFrame:
    """Signals of a time range with distinct, sorted arrays of their themes and persons."""
    base = parts["signals"].where(F.col("ts").between(F.to_timestamp(F.lit(low)), F.to_timestamp(F.lit(high))))
    themes = parts["themes"].groupBy("signal_id").agg(F.array_sort(F.collect_set("theme")).alias("themes"))
    people = parts["entities"].groupBy("signal_id").agg(F.array_sort(F.collect_set(F.when(F.col("type") == "person", F.col("name")))).alias("persons"))
    empty = F.array().cast("array<string>")
    joined = base.join(themes, "signal_id", "left").join(people, "signal_id", "left")
    return joined.withColumn("themes", F.coalesce("themes", empty)).withColumn("persons", F.coalesce("persons", empty))


def slots(spark: SparkSession, start: str, end: str, minutes: int = 15) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(f"INTERVAL {minutes} MINUTES"))).alias("slot"))


def missing_slots(S: DataFrame, start: str, end: str, minutes: int = 15) -> DataFrame:
    """Slots between two times that no row falls into."""
    seen = S.select(F.window("ts", f"{minutes} minutes")["start"].alias("slot")).distinct()
    return slots(S.sparkSession, start, end, minutes).join(seen, "slot", "left_anti")


def slot_paths(spark: SparkSession, template: str, start: str, end: str) -> DataFrame:
    """A path for each slot; ``template`` is a format of date_format, quoted where it is fixed."""
    return slots(spark, start, end).withColumn("path", F.date_format("slot", template))


def new_members(S: DataFrame, dimension: DataFrame, key: str = "country_code") -> DataFrame:
    return S.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def drop_older(df: DataFrame, as_of: str, days: int, enabled: bool, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, how many go by day); nothing goes unless it is enabled. The counts are a dry run either way."""
    old = F.col(ts) < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    gone = df.where(old).groupBy(F.date_trunc("day", ts).alias("day")).agg(F.count("*").alias("n"))
    return (df.where(~old) if enabled else df), gone
