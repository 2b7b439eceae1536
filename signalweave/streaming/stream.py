"""The micro-batch side: landing files to signals, deduplication, rolling counts, latest positions, merges, metrics."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import normalize

#: Hours that a feed's items may be late, and minutes between its fetches.
LATE_HOURS = {"gdelt": 2, "rss": 4, "api": 24, "ngo": 168, "social": 4}
EVERY_MINUTES = {"gdelt": 15, "rss": 30, "api": 60, "ngo": 120, "trends": 60, "pageviews": 1440}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; where none is set, a local one, for a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="signalweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def stream_signals(spark: SparkSession, path: str, source_lang: str = "en") -> DataFrame:
    """Landed files to signals; the same select as in batch. Restarts go on after the last file of the checkpoint."""
    return normalize.read_and_normalize(stream_lines(spark, path), source_lang)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None):
    """Runs a stream into ``sink`` until its input is used up, or by another trigger, and waits for the end."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return query


def update_log(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch's rows under its number; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_of_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch: the table that an upsert would have left."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("x")).select(*keys, "x.*")


def accepted(df: DataFrame, as_of: str | None = None, late_hours: dict[str, int] = LATE_HOURS, default: int = 24) -> DataFrame:
    """Rows that are not later than their feed allows, measured from their arrival (``created_at``) or ``as_of``."""
    now = F.col("created_at") if as_of is None else F.to_timestamp(F.lit(as_of))
    hours = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in late_hours.items() for x in kv]), F.col("source_family")), F.lit(default))
    return df.where(now.cast("double") - F.col("ts").cast("double") <= hours * 3600)


def dedup_stream(df: DataFrame, key: str = "source_url", late: str = "2 hours") -> DataFrame:
    """The first row of a key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_theme_hourly(df: DataFrame, late: str = "2 hours") -> DataFrame:
    """Theme hours, given out again while late rows come: exact counts and mean, distinct countries and outlets approximately."""
    rows = df.withWatermark("ts", late).select("ts", "country_code", "source_name", "sentiment", F.explode("themes").alias("theme"))
    per = rows.groupBy(F.window("ts", "1 hour").alias("w"), "theme").agg(F.count("*").alias("signal_count"), F.avg("sentiment").alias("avg_sentiment"), F.approx_count_distinct("country_code").alias("countries"), F.approx_count_distinct("source_name").alias("sources"))
    return per.select(F.col("w.start").alias("hour"), "theme", "signal_count", F.round("avg_sentiment", 6).alias("avg_sentiment"), "countries", "sources")


def stream_buckets(df: DataFrame, width: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    per = df.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "country_code").agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("slot"), "country_code", "n")


def stream_velocity(df: DataFrame, width: str = "2 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding counts: in each window the rows of its second and of its first half."""
    half = F.col("ts") >= F.timestamp_seconds((F.col("w.start").cast("double") + F.col("w.end").cast("double")) / 2)
    rows = df.withWatermark("ts", late).select("ts", F.window("ts", width, slide).alias("w"))
    per = rows.groupBy("w").agg(F.count_if(half).alias("last"), F.count_if(~half).alias("previous"))
    return per.select(F.col("w.end").alias("upto"), "last", "previous")


POSITION = "vessel string, ts timestamp, latitude double, longitude double"


def latest_positions(df: DataFrame, expire_minutes: int = 10, late: str = "10 minutes", box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)) -> DataFrame:
    """Each vessel's latest place (vessel, ts, latitude, longitude, expired); silent for ``expire_minutes`` it is given out as expired.

    Rows without a vessel, a time or a place within the box are bad and go. State: one row a vessel.
    """
    low, high, west, east = box
    good = df.where(F.col("vessel").isNotNull() & F.col("ts").isNotNull() & F.col("latitude").between(low, high) & F.col("longitude").between(west, east))

    def step(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            ts, lat, lon = state.get
            state.remove()
            yield pd.DataFrame({"vessel": [key[0]], "ts": [pd.Timestamp(ts, unit="us")], "latitude": [lat], "longitude": [lon], "expired": [True]})
            return
        best = tuple(state.get) if state.exists else None
        for b in batches:
            last = b.sort_values(["ts", "latitude", "longitude"]).iloc[-1]
            new = (int(last.ts.value // 1000), float(last.latitude), float(last.longitude))
            best = new if best is None or new > best else best
        state.update(best)
        until = best[0] // 1000 + expire_minutes * 60_000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"vessel": [key[0]], "ts": [pd.Timestamp(best[0], unit="us")], "latitude": [best[1]], "longitude": [best[2]], "expired": [False]})

    return good.select("vessel", "ts", "latitude", "longitude").withWatermark("ts", late).groupBy("vessel").applyInPandasWithState(step, POSITION + ", expired boolean", "ts long, latitude double, longitude double", "update", GroupStateTimeout.EventTimeTimeout)


def partial_log(path: str, partial: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch's partial aggregate under its number, so a batch costs what it holds, whatever came before it.

    A batch that is run again replaces its own part. ``merged`` of the parts is the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def batch_metrics(query) -> dict:
    """Rows in, rows a second and duration of a stream's last batch."""
    return progress_metrics(query.lastProgress or {})


def progress_metrics(p) -> dict:
    """Number, rows in, rows a second and duration of a batch."""
    return {"batch": p.get("batchId", 0), "rows": p.get("numInputRows", 0), "rows_per_second": p.get("processedRowsPerSecond", 0.0), "ms": (p.get("durationMs") or {}).get("triggerExecution", 0)}


def counted(df: DataFrame, name: str = "ingest"):
    """The frame with observed counts of all rows and of those without a URL, and the observation to read after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("source_url").isNull()).alias("without_url")), seen
