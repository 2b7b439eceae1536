"""Streams with state and timers: restarts, rows out of order, visits that a late row joins."""

import pandas as pd
from pyspark.sql import functions as F

from signalweave.plans import streams
from signalweave.plans.fixture import Tables
from signalweave.streaming import stateful, stream

SHIPS = "vessel string, ts timestamp, latitude double, longitude double"


def land(spark, path, name, rows):
    df = spark.createDataFrame([(v, f"2024-01-01 {at}", la, lo) for v, at, la, lo in rows], "vessel string, ts string, latitude double, longitude double")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{path}/{name}")


def test_a_restart_goes_on_from_the_state(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    ships = lambda: spark.readStream.schema(SHIPS).option("maxFilesPerTrigger", 1).parquet(f"{landing}/*")
    found = lambda: [(r.vessel, str(r.ts)[11:16], r.latitude, r.expired) for r in spark.read.parquet(out).orderBy("batch", "vessel", "ts").collect()]
    with stateful.enabled(spark):
        land(spark, landing, "0", [("a", "00:00:00", 1.0, 2.0), ("a", "00:05:00", 3.0, 2.0), ("b", "00:01:00", 1.0, 2.0), (None, "00:01:00", 1.0, 2.0), ("c", "00:01:00", 95.0, 2.0)])
        stream.run_available(stateful.last_positions(ships()), stream.update_log(out), str(tmp_path / "checkpoint"), "update")
        assert found() == [("a", "00:05", 3.0, False), ("b", "00:01", 1.0, False)]
        land(spark, landing, "1", [("a", "00:04:00", 9.0, 9.0), ("b", "00:06:00", 5.0, 5.0)])  # a's row is older than what is known
        land(spark, landing, "2", [("d", "05:00:00", 5.0, 5.0)])
        stream.run_available(stateful.last_positions(ships()), stream.update_log(out), str(tmp_path / "checkpoint"), "update")
    assert found()[2:] == [("b", "00:06", 5.0, False), ("d", "05:00", 5.0, False), ("a", "00:05", 3.0, True), ("b", "00:06", 5.0, True)]
    assert spark.conf.get(stateful.STORE[0], None) != stateful.STORE[1]


def test_visits(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    land(spark, landing, "0", [("a", "00:00:00", 0.0, 0.0), ("a", "00:50:00", 0.0, 0.0), ("b", "00:10:00", 0.0, 0.0)])
    land(spark, landing, "1", [("a", "00:25:00", 0.0, 0.0), ("b", "01:30:00", 0.0, 0.0), ("b", "01:30:00", 0.0, 0.0)])  # a's late row joins two visits
    land(spark, landing, "2", [("z", "09:00:00", 0.0, 0.0)])
    ships = spark.readStream.schema(SHIPS).option("maxFilesPerTrigger", 1).parquet(f"{landing}/*")
    with stateful.enabled(spark):
        stream.run_available(stateful.sessions(ships, "vessel", 30, "2 hours"), stream.update_log(out), str(tmp_path / "checkpoint"))
    got = sorted((r.key, str(r.start)[11:16], str(r.end)[11:16], r.n) for r in spark.read.parquet(out).collect())
    assert got == [("a", "00:00", "00:50", 3), ("b", "00:10", "00:10", 1), ("b", "01:30", "01:30", 2)]


class Counted:
    """A map state, and a handle, that count how often they are asked."""

    def __init__(self, rows):
        self.rows, self.asked, self.timers = dict(rows), 0, []

    def getMapState(self, *_):
        return self

    def iterator(self):
        self.asked += 1
        return iter(list(self.rows.items()))

    def updateValue(self, key, value):
        self.asked += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self.rows[key]

    def listTimers(self):
        return []

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_batch_asks_the_state_by_visit_not_by_row():
    state = Counted({(0,): (10, 2), (500,): (500, 1)})
    visits = stateful.Sessions(100)
    visits.init(state)
    frames = [pd.DataFrame({"ms": [900, 899, *range(60, 91)]}), pd.DataFrame({"ms": [1001, 190, 800]})]
    assert list(visits.handleInputRows(("a",), iter(frames), state)) == []
    assert state.rows == {(0,): (190, 34), (500,): (500, 1), (800,): (900, 3), (1001,): (1001, 1)}
    assert state.asked == 4 and state.timers == [291]


def test_a_part_is_one_batch_of_several_files(spark, small, tmp_path):
    parts = ["ts < '2024-01-12'", "ts < '2000-01-01'", "ts >= '2024-01-12' and event_id % 100 = 0"]
    out = str(tmp_path / "out")
    query = stream.run_available(streams.staged(Tables(spark, small), parts, 50).select("signal_id"), stream.update_log(out), str(tmp_path / "checkpoint"))
    events = spark.read.parquet(f"{small}/events.parquet")
    assert [r.n for r in spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [events.where(p).count() for p in (parts[0], parts[2])]
    assert [p["numInputRows"] for p in query.recentProgress][:3] == [events.where(p).count() for p in parts]
    assert spark.read.parquet(out + "/batch=0").rdd.getNumPartitions() > 1
