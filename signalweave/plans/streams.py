"""Queries: streams over the events table, run until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest, stateful
from ..streaming import stream as M
from . import landing
from .fixture import SIGNALS, SPARK
from .registry import query


def streamed_signals(t):
    """The signals view with the events as a stream."""
    events = t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.sf_dir}/events.parquet*")
    return t.spark.sql(SIGNALS.format(**SPARK, events="{events}", customer="{customer}", nation="{nation}"), events=events, customer=t.raw("customer"), nation=t.raw("nation"))


def _logged(t, df, name, keys, mode="update"):
    path = M.scratch(t.spark, name)
    M.run_available(df, M.update_log(path), path + "-checkpoint", mode)
    return M.latest_of_log(t.spark, path, keys)


@query("m3_dedup_stream", "SELECT count(DISTINCT source_url) AS urls FROM signals")
def m3(t):
    """All rows come in one batch, so the first of each URL is found whatever the watermark."""
    path = M.scratch(t.spark, "m3")
    M.run_available(M.dedup_stream(streamed_signals(t)).select("source_url"), M.update_log(path), path + "-checkpoint")
    return t.spark.read.parquet(path).agg(F.count("*").alias("urls"))


@query("m4_theme_hourly_stream", ", t AS (SELECT ts, sentiment, unnest(themes) AS theme FROM signals) SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, theme, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment FROM t GROUP BY ALL")
def m4(t):
    rows = _logged(t, M.stream_theme_hourly(streamed_signals(t)), "m4", ["hour", "theme"])
    return rows.select(F.col("hour").cast("string").alias("hour"), "theme", "signal_count", "avg_sentiment")


@query("m5_accepted_rows", "SELECT source_family, count(*) AS n FROM signals WHERE epoch(TIMESTAMP '2024-01-31') - epoch(ts) <= 3600 * CASE source_family WHEN 'gdelt' THEN 200 WHEN 'social' THEN 100 ELSE 300 END GROUP BY ALL")
def m5(t):
    return M.accepted(t.signals, "2024-01-31 00:00:00", {"gdelt": 200, "social": 100}, 300).groupBy("source_family").agg(F.count("*").alias("n"))


@query("m6_velocity_stream", ", w AS (SELECT ts, unnest([time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOURS]) AS upto FROM signals) SELECT CAST(upto AS VARCHAR) AS upto, count(*) FILTER (WHERE ts >= upto - INTERVAL 1 HOUR) AS last, count(*) FILTER (WHERE ts < upto - INTERVAL 1 HOUR) AS previous FROM w GROUP BY ALL")
def m6(t):
    rows = _logged(t, M.stream_velocity(streamed_signals(t), "2 hours", "1 hour"), "m6", ["upto"])
    return rows.withColumn("upto", F.col("upto").cast("string"))


@query("m7_quarter_hours", "SELECT CAST(time_bucket(INTERVAL 15 MINUTES, ts) AS VARCHAR) AS slot, country_code, count(*) AS n FROM signals GROUP BY ALL")
def m7(t):
    rows = _logged(t, M.stream_buckets(streamed_signals(t)), "m7", ["slot", "country_code"])
    return rows.withColumn("slot", F.col("slot").cast("string"))


def staged(t, parts, rows_per_file=50_000):
    """The signals as a stream of several batches: ``parts`` are conditions on the events, a batch each, in order.

    Each part is landed as the same number of files, so that a batch, which takes that many, is one part and has many tasks.
    """
    path, events = M.scratch(t.spark, "staged"), t.raw("events")
    files = max(1, min(t.spark.sparkContext.defaultParallelism, events.count() // (len(parts) * rows_per_file)))
    for i, where in enumerate(parts):
        rows = events.where(where)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.parquet(f"{path}/{i}")
        # a part of few rows has fewer files; empty ones make up for them
        for _ in range(files - len(t.spark.read.parquet(f"{path}/{i}").inputFiles())):
            events.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    return t.spark.sql(SIGNALS.format(**SPARK, events="{events}", customer="{customer}", nation="{nation}"), events=stream, customer=t.raw("customer"), nation=t.raw("nation"))


#: Four batches: some rows of the second are late but within ten days, some of the last are later than that and go.
IN_TIME = [
    "ts < '2024-01-11' and event_id % 10 not in (0, 1)",
    "ts >= '2024-01-11' and ts < '2024-01-16' or ts >= '2024-01-05' and ts < '2024-01-11' and event_id % 10 = 0",
    "ts >= '2024-01-16' and ts < '2024-01-21'",
]
LATE = [*IN_TIME, "ts >= '2024-01-21' or ts < '2024-01-04' and event_id % 10 = 1"]
KEPT = "(ts >= TIMESTAMP '2024-01-11' OR signal_id % 10 NOT IN (0, 1) OR (ts >= TIMESTAMP '2024-01-05' AND signal_id % 10 = 0))"


@query("m4_theme_hours_late", f", t AS (SELECT ts, sentiment, unnest(themes) AS theme FROM signals WHERE {KEPT}) SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, theme, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment FROM t GROUP BY ALL")
def m4l(t):
    """Hours that later batches add to are given out again; what is over ten days late goes."""
    rows = _logged(t, M.stream_theme_hourly(staged(t, LATE), "10 days"), "m4l", ["hour", "theme"])
    return rows.select(F.col("hour").cast("string").alias("hour"), "theme", "signal_count", "avg_sentiment")


@query("m7_quarter_hours_late", f"SELECT CAST(time_bucket(INTERVAL 15 MINUTES, ts) AS VARCHAR) AS slot, country_code, count(*) AS n FROM signals WHERE {KEPT} GROUP BY ALL")
def m7l(t):
    rows = _logged(t, M.stream_buckets(staged(t, LATE), late="10 days"), "m7l", ["slot", "country_code"])
    return rows.withColumn("slot", F.col("slot").cast("string"))


@query("m6_velocity_late", f", w AS (SELECT ts, unnest([time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 2 HOURS]) AS upto FROM signals WHERE {KEPT}) SELECT CAST(upto AS VARCHAR) AS upto, count(*) FILTER (WHERE ts >= upto - INTERVAL 1 HOUR) AS last, count(*) FILTER (WHERE ts < upto - INTERVAL 1 HOUR) AS previous FROM w GROUP BY ALL")
def m6l(t):
    rows = _logged(t, M.stream_velocity(staged(t, LATE), "2 hours", "1 hour", "10 days"), "m6l", ["upto"])
    return rows.withColumn("upto", F.col("upto").cast("string"))


@query("m3_dedup_urls_late", f"SELECT source_url FROM signals WHERE {KEPT} GROUP BY ALL")
def m3l(t):
    """URLs come again in later batches, within the watermark."""
    path = M.scratch(t.spark, "m3l")
    M.run_available(M.dedup_stream(staged(t, [*IN_TIME, "ts >= '2024-01-21'"]), late="40 days").select("source_url", "ts"), M.update_log(path), path + "-checkpoint")
    return t.spark.read.parquet(path).select("source_url")


@query("m5_accepted_stream", f"SELECT signal_id, source_family FROM signals WHERE {KEPT} AND epoch(TIMESTAMP '2024-01-31') - epoch(ts) <= 3600 * CASE source_family WHEN 'gdelt' THEN 200 WHEN 'social' THEN 100 ELSE 300 END")
def m5s(t):
    """The rule of each feed in a stream of four batches."""
    path = M.scratch(t.spark, "m5s")
    rows = M.accepted(staged(t, [*IN_TIME, "ts >= '2024-01-21'"]), "2024-01-31 00:00:00", {"gdelt": 200, "social": 100}, 300)
    M.run_available(rows.select("signal_id", "source_family"), M.update_log(path), path + "-checkpoint")
    return t.spark.read.parquet(path).select("signal_id", "source_family")


@query("m8_latest_positions", "SELECT 'v' || (signal_id % 300) AS vessel, CAST(max(ts) AS VARCHAR) AS ts FROM signals WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY ALL")
def m8(t):
    ships = streamed_signals(t).select(F.concat(F.lit("v"), (F.col("signal_id") % 300).cast("string")).alias("vessel"), "ts", "latitude", "longitude")
    path = M.scratch(t.spark, "m8")
    M.run_available(M.latest_positions(ships), M.update_log(path), path + "-checkpoint", "update")
    rows = t.spark.read.parquet(path)
    return rows.groupBy("vessel").agg(F.max("ts").cast("string").alias("ts"))


M8_EXPIRY = ", s AS (SELECT 'v' || (signal_id % 300) AS vessel, ts, latitude, longitude FROM signals WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND ts < TIMESTAMP '2024-01-27'), l AS (SELECT vessel, max(ts) AS ts, arg_max(latitude, (ts, latitude, longitude)) AS latitude, arg_max(longitude, (ts, latitude, longitude)) AS longitude FROM s GROUP BY ALL) SELECT vessel, CAST(ts AS VARCHAR) AS ts, latitude, longitude, ts + INTERVAL 2 DAYS < (SELECT max(ts) FROM s) - INTERVAL 1 HOUR AS expired FROM l"


@query("m8_positions_expiry", M8_EXPIRY)
def m8e(t):
    """Places in three batches by time; vessels that are silent for two days are given out as expired, with their last place."""
    parts = ["ts < '2024-01-12'", "ts >= '2024-01-12' and ts < '2024-01-20'", "ts >= '2024-01-20' and ts < '2024-01-27'"]
    ships = staged(t, parts).select(F.concat(F.lit("v"), (F.col("signal_id") % 300).cast("string")).alias("vessel"), "ts", "latitude", "longitude")
    path = M.scratch(t.spark, "m8e")
    M.run_available(M.latest_positions(ships, expire_minutes=2 * 1440, late="1 hour"), M.update_log(path), path + "-checkpoint", "update")
    rows = t.spark.read.parquet(path)
    last = rows.groupBy("vessel").agg(F.max_by(F.struct("latitude", "longitude", "expired"), F.struct("ts", "expired")).alias("x"), F.max("ts").alias("ts"))
    return last.select("vessel", F.col("ts").cast("string").alias("ts"), "x.latitude", "x.longitude", "x.expired")


SHIPS = ["ts < '2024-01-12'", "ts >= '2024-01-12' and ts < '2024-01-20'", "ts >= '2024-01-20' and ts < '2024-01-27'"]


def _ships(t):
    return staged(t, SHIPS).select(F.concat(F.lit("v"), (F.col("signal_id") % 300).cast("string")).alias("vessel"), "ts", "latitude", "longitude")


@query("m8_timed_positions", M8_EXPIRY)
def m8t(t):
    """The same with typed state and timers."""
    path = M.scratch(t.spark, "m8t")
    with stateful.enabled(t.spark):
        M.run_available(stateful.last_positions(_ships(t), 2 * 1440, "1 hour"), M.update_log(path), path + "-checkpoint", "update")
    last = t.spark.read.parquet(path).groupBy("vessel").agg(F.max_by(F.struct("latitude", "longitude", "expired"), F.struct("ts", "expired")).alias("x"), F.max("ts").alias("ts"))
    return last.select("vessel", F.col("ts").cast("string").alias("ts"), "x.latitude", "x.longitude", "x.expired")


@query("m8_visits", ", s AS (SELECT 'v' || (signal_id % 300) AS vessel, epoch_us(ts) // 1000 AS ms FROM signals WHERE ts < TIMESTAMP '2024-01-27'), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY vessel ORDER BY ms) <= 43200000 THEN 0 ELSE 1 END AS fresh FROM s), v AS (SELECT *, sum(fresh) OVER (PARTITION BY vessel ORDER BY ms ROWS UNBOUNDED PRECEDING) AS visit FROM g), e AS (SELECT vessel, visit, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n FROM v GROUP BY ALL) SELECT vessel, start_ms, end_ms, n FROM e WHERE end_ms + 43200000 < (SELECT max(ms) FROM s) - 3600000")
def m8v(t):
    """Visits of each vessel: rows with half a day between them at most; those that are over by event time."""
    path = M.scratch(t.spark, "m8v")
    with stateful.enabled(t.spark):
        M.run_available(stateful.sessions(_ships(t), "vessel", 720, "1 hour"), M.update_log(path), path + "-checkpoint")
    return t.spark.read.parquet(path).select(F.col("key").alias("vessel"), F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


@query("m10_running_statistics", "SELECT country_code, count(sentiment) AS n, min(sentiment) AS low, max(sentiment) AS high, round(avg(sentiment), 6) AS mean FROM signals GROUP BY ALL")
def m10(t):
    """Partial aggregates of three batches, merged when they are read."""
    from ..operators import rollups as R

    path = M.scratch(t.spark, "m10")
    parts = ["ts < '2024-01-11'", "ts >= '2024-01-11' and ts < '2024-01-21'", "ts >= '2024-01-21'"]
    M.run_available(staged(t, parts), M.partial_log(path, lambda batch: R.partials(batch, ["country_code"])), path + "-checkpoint")
    return R.merge_aggregates(t.spark.read.parquet(path).drop("batch"), R.partials(t.signals.limit(0), ["country_code"]), ["country_code"]).select("country_code", "n", "low", "high", "mean")


LINES = "WHERE signal_id % 10 NOT IN (3, 7)"
THEMED = f", x AS (SELECT date_trunc('hour', ts) AS hour, sentiment, source_name, CASE signal_id % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'US' ELSE 'FR' END AS country, list_concat(['KILL'], list_filter(themes, lambda x: length(x) > 2)) AS themes FROM signals {LINES})"


def part_of(value):
    return F.when(value.startswith("short"), F.lit(0)).otherwise(F.pmod(F.xxhash64(value), F.lit(4)))


def ingested(t):
    """The tables after two runs of the ingest job: files of the first days, then later ones, with a third of the first files' lines again."""
    base, rows, cores = M.scratch(t.spark, "ingest"), t.raw("events").count(), t.spark.sparkContext.defaultParallelism
    # made once, and landed by all cores; small tables are two files a part
    landing.gkg_lines(t).withColumn("part", part_of(F.col("value"))).write.parquet(f"{base}/lines")
    lines = t.spark.read.parquet(f"{base}/lines")
    files = max(2, min(cores, rows // 200_000))
    # about a key a byte of a bucket's filter
    buckets = max(4, rows // 100_000)
    options = {"files_per_batch": files, "buckets": buckets, "filter_bytes": max(4096, min(1 << 17, rows // buckets)), "hours": 24}

    def land(name, where):
        lines.where(where).select("value").repartition(files).write.text(f"{base}/landing/{name}")

    land("a", "part = 0")
    land("b", "part = 1")
    first = ingest.run(t.spark, f"{base}/landing/*", f"{base}/tables", f"{base}/checkpoint", **options)
    land("c", "part = 2 or part = 0 and length(value) % 3 = 0")
    land("d", "part = 3 or part = 1")
    second = ingest.run(t.spark, f"{base}/landing/*", f"{base}/tables", f"{base}/checkpoint", **options)
    return base + "/tables", [*first, *second]


@query("m1_ingested_theme_hours", THEMED + ", t AS (SELECT hour, sentiment, source_name, country, unnest(themes) AS theme FROM x) SELECT CAST(hour AS VARCHAR) AS hour, theme, count(*) AS signal_count, count(DISTINCT country) AS countries, count(DISTINCT source_name) AS sources, round(avg(sentiment), 6) AS avg_sentiment FROM t GROUP BY ALL")
def m1(t):
    """The theme rollup that the ingest job keeps, over several batches with repeated lines and a second run that goes on."""
    rows = t.spark.read.parquet(ingested(t)[0] + "/theme_hourly")
    return rows.select(F.col("hour").cast("string").alias("hour"), "theme", "signal_count", "countries", "sources", "avg_sentiment")


@query("m11_ingest_batches", "SELECT count(*) AS rows_in FROM signals")
def m11(t):
    """Rows that the job's batches report, less those that were landed twice."""
    base, batches = ingested(t)
    signals = t.spark.read.parquet(base + "/signals")
    assert signals.select("source_url").distinct().count() == signals.count()
    lines = t.spark.read.parquet(base.removesuffix("/tables") + "/lines")
    again = lines.where((F.col("part") == 1) | (F.col("part") == 0) & (F.length("value") % 3 == 0)).count()
    return t.spark.createDataFrame([(sum(b["rows"] for b in batches) - again,)], "rows_in long")
