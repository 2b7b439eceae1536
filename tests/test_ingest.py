"""Ingest at the cost of the batch: index of seen keys, touched hours, merged batches, retention by partition."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from signalweave.sources import partitions, seen
from signalweave.streaming import ingest

RNG = random.Random(2)
PLACE = "4#Los Angeles, California, United States#US#USCA#CA037#34.0522#-118.244#1662328#1325"


def line(url, stamp):
    return "\t".join([url, stamp, "1", "src.com", f"https://src.com/{url}-long-title", "", "", "", "KILL,3;AB,1", "", PLACE, "", "joe doe,4", "", "", "-2,1,1,1,1,1,9"] + [""] * 11)


def frame(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "value string")


def bytes_read(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalInputBytes()


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_filters_never_deny():
    keys = [RNG.randbytes(16) for _ in range(3000)]
    bits = np.zeros(4096, dtype=np.uint8)
    seen.put(bits, keys[:2000])
    assert seen.may_have(bits, keys[:2000]).all() and seen.may_have(bits, keys[2000:]).mean() < 0.05


def test_new_rows_of_batches(spark, tmp_path):
    """Against a set of all keys: repeats within and across batches, null keys, a batch that runs again, a rebuilt index."""
    index = seen.SeenKeys(spark, str(tmp_path / "seen"), buckets=8, filter_bytes=64)
    known: set = set()
    for number in range(4):
        rows = [(number * 100 + i, None if i % 17 == 0 else f"k{RNG.randrange(120)}") for i in range(60)]
        want = {}
        for i, k in rows:
            if k is not None and k not in known:
                want.setdefault(k, i)
        new = spark.createDataFrame(rows, "i long, k string")
        for _ in range(2 if number % 2 else 1):
            got = index.new_rows(new, "k", number, [F.asc("i")]).collect()
            assert {r.k: r.i for r in got if r.k is not None} == want and sum(r.k is None for r in got) == sum(k is None for _, k in rows) and len(got) == len(want) + 4
        known |= set(want)
        if number == 2:
            assert index.merge(1) > 0 and index.merge(1) == 0
            index = index.rebuilt(str(tmp_path / "larger"), 16, 128)
    assert index.new_rows(new.limit(0), "k", 9, [F.asc("i")]).count() == 0


def test_batches_cost_what_they_hold(spark, tmp_path):
    """Ten batches of 40 lines, a tenth of them seen before: the bytes that a batch reads stay level, and so do the files that it changes."""
    sink, urls, cost, changed = ingest.signals_sink(str(tmp_path), buckets=64, filter_bytes=512), [], [], []
    for number in range(10):
        new = [f"u{number}-{i}" for i in range(36)]
        rows = [line(u, f"202401{1 + number:02d}120000") for u in new] + [line(u, f"202401{1 + number:02d}120000") for u in (RNG.sample(urls, 4) if urls else new[:4])]
        urls += new
        before, at = bytes_read(spark), files(tmp_path)
        sink(frame(spark, rows), number)
        cost.append(bytes_read(spark) - before)
        now = files(tmp_path)
        changed.append(sum(at[f] != now.get(f) for f in at if "signals" in f or "hourly" in f))
    assert spark.read.parquet(f"{tmp_path}/signals").count() == len(urls) == 360
    assert max(cost[5:]) < 1.5 * max(cost[1:4]), cost
    assert set(changed) == {0}  # each batch is an hour of its own, so no earlier file is touched
    assert spark.read.parquet(f"{tmp_path}/theme_hourly").where("theme = 'KILL'").agg(F.sum("signal_count")).first()[0] == 360


def test_merged_batches_hold_the_same_rows(spark, tmp_path):
    sink = ingest.signals_sink(str(tmp_path), buckets=4, filter_bytes=256)
    for number in range(3):
        sink(frame(spark, [line(f"m{number}-{i}", "20240101120000") for i in range(5)] + [line("m0-0", "20240101130000")]), number)
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/signals").select("source_url", "ts", "day", "h").collect())
    before = rows()
    assert len(before) == 15 and ingest.merge(spark, str(tmp_path), 1, 4, 256) > 0
    assert rows() == before and set(partitions.listed(spark, f"{tmp_path}/signals/day=2024-01-01/h=12", "batch")) == {"1", "2"}
    sink(frame(spark, [line("m1-1", "20240101120000"), line("fresh", "20240101120000")]), 3)
    assert len(rows()) == 16


def test_retention_by_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(240).select(F.col("id"), (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    df = df.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("h", (F.hour("ts") / 12).cast("int"))
    partitions.overwrite(df, path, ["day", "h"])
    at = files(path)
    want = [("2024-01-01", 24), ("2024-01-02", 24), ("2024-01-03", 24), ("2024-01-04", 15)]
    assert partitions.retain(spark, path, "2024-01-10 15:00:00", 6, False) == want and files(path) == at
    assert partitions.retain(spark, path, "2024-01-10 15:00:00", 6, True) == want
    now = files(path)
    assert {r.id for r in spark.read.parquet(path).collect()} == set(range(24 * 3 + 15, 240))
    assert {f: t for f, t in at.items() if f.split("day=")[1][:10] > "2024-01-04"} == {f: t for f, t in now.items() if f.split("day=")[1][:10] > "2024-01-04"}
    assert not any("day=2024-01-04/h=0" in f for f in now) and partitions.retain(spark, path, "2024-01-10 15:00:00", 6, True) == []
