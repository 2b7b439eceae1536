"""Ingest as a job: landed files to signals, deduplicated, appended, with the rollups of the hours that they touch.

Tables below one folder: ``signals`` (partitions day, h, batch), ``theme_hourly`` and ``country_hourly`` (partitions day, h), and ``seen``, the index of
URLs. A micro-batch costs what it holds: which of its URLs are new it learns from the index, and it reads and writes the hours that it touches
alone. It writes its own partitions of signals and those hours of rollups, whole and from the signals there, so a batch that runs again
after a failure leaves the same tables. ``merge`` makes one file of an hour's old batches. Which files are done is in the stream's checkpoint: a job that is started again
goes on after them, and a backfill is the same job over the slots that had not landed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups as R
from ..sources import normalize, partitions
from ..sources.seen import SeenKeys
from . import stream

ROLLUPS = {"theme_hourly": R.theme_hourly, "country_hourly": R.country_hourly}


def signals_sink(tables: str, source_lang: str = "en", blocked: list[str] | None = None, buckets: int = 256, filter_bytes: int = 1 << 17, hours: int = 1) -> Callable[[DataFrame, int], None]:
    """A sink of landed lines: their signals with new URLs, then the rollups of touched hours.

    A partition holds ``hours`` hours of a day; 24 is for backfills, whose batches touch many days.
    """

    def write(lines: DataFrame, number: int) -> None:
        spark = lines.sparkSession
        # parsed once; what a lost executor held is parsed again from the files
        found = normalize.gkg_to_signals(normalize.parse.read_gkg(lines)[0], source_lang, blocked).persist(StorageLevel.DISK_ONLY)
        index = SeenKeys(spark, f"{tables}/seen", buckets, filter_bytes)
        fresh = index.new_rows(found, "source_url", number, [F.asc("ts"), F.asc("signal_id")])
        dated = fresh.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("h", _slot("ts", hours)).withColumn("batch", F.lit(number))
        partitions.overwrite(dated, f"{tables}/signals", ["day", "h", "batch"])
        found.unpersist()
        refresh(spark, tables, number, hours)

    return write


def _slot(ts: str, hours: int) -> Column:
    return (F.floor(F.hour(ts) / hours) * hours).cast("int")


def refresh(spark: SparkSession, tables: str, number: int, hours: int = 1) -> None:
    """Rollups of the hours that batch ``number`` has rows of, from all their signals; other hours are neither read nor written."""
    found = [hour for day in partitions.listed(spark, f"{tables}/signals", "day").values() for hour in partitions.listed(spark, day, "h").values()]
    touched = [path for path in found if partitions.exists(spark, f"{path}/batch={number}")]
    if not touched:
        return
    rows = spark.read.option("basePath", f"{tables}/signals").parquet(*touched)
    for name, make in ROLLUPS.items():
        made = make(rows).withColumn("day", F.date_format("hour", "yyyy-MM-dd")).withColumn("h", _slot("hour", hours))
        partitions.overwrite(made, f"{tables}/{name}", ["day", "h"])


def merge(spark: SparkSession, tables: str, upto: int, buckets: int = 256, filter_bytes: int = 1 << 17) -> int:
    """Old batches of each hour, and of each bucket of the index, as one; gives how many folders went. For times without a running batch."""
    return partitions.merge_batches(spark, f"{tables}/signals", ["day", "h"], upto, "source_url") + SeenKeys(spark, f"{tables}/seen", buckets, filter_bytes).merge(upto)


def run(spark: SparkSession, landing: str, tables: str, checkpoint: str, files_per_batch: int = 8, trigger: dict | None = None, **options) -> list[dict]:
    """Takes in what has landed and not been taken in, and tells each batch's rows and time."""
    query = stream.run_available(stream.stream_lines(spark, landing, files_per_batch), signals_sink(tables, **options), checkpoint, trigger=trigger)
    return [stream.progress_metrics(p) for p in query.recentProgress]
