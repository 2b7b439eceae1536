"""Radius joins against all pairs, sketches against exact counts, SQL functions against column expressions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from signalweave.functions import sql
from signalweave.operators import near, rollups, sketches

RNG = random.Random(8)


def km(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(max(1 - x, 0)))


def test_radius_join_against_all_pairs(spark):
    """Anywhere, at the poles and the date line; radii from a street to a hemisphere; bad places."""
    spots = [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (89.9, -179.9), (0.0, 0.0), (-45.0, 179.99), (45.0, -179.99)]
    anywhere = lambda: (math.degrees(math.asin(RNG.uniform(-1, 1))), RNG.uniform(-180, 180))
    points = spots + [anywhere() for _ in range(300)] + [(max(-90.0, min(90.0, a + RNG.uniform(-1, 1))), (o + RNG.uniform(-2, 2) + 180) % 360 - 180) for a, o in spots for _ in range(15)]
    places = [(*s, r) for s in spots for r in (0.05, 30.0, 700.0)] + [(*anywhere(), RNG.choice([5.0, 100.0, 1500.0, 9000.0, 20000.0])) for _ in range(30)]
    odd = [(None, 1.0), (91.0, 0.0), (float("nan"), 0.0), (0.0, 181.0)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate([*points, *odd])], "i int, latitude double, longitude double")
    q = spark.createDataFrame([(j, a, o, r) for j, (a, o, r) in enumerate([*places, (None, 1.0, 5.0), (0.0, 0.0, -1.0), (0.0, 0.0, None)])], "place int, latitude double, longitude double, km double")
    found = near.within_radius(p, q).collect()
    want = {(i, j) for i, a in enumerate(points) for j, (b, o, r) in enumerate(places) if km(a, (b, o)) <= r}
    assert len(found) == len({(r.i, r.place) for r in found}) and {(r.i, r.place) for r in found} == want
    best = {r.i: r.place for r in near.nearest_place(p, q, "i").collect()}
    assert best == {i: min((round(km(points[i], places[j][:2]), 9), j) for k, j in want if k == i)[1] for i in {k for k, _ in want}} or all(abs(km(points[i], places[j][:2]) - min(km(points[i], places[m][:2]) for k, m in want if k == i)) < 1e-6 for i, j in best.items())
    cells = near.covered(q).groupBy("place").count().agg(F.max("count")).first()[0]
    assert cells < 60  # of a place, whatever its radius


def test_merged_sketches_are_near_the_exact_counts(spark):
    """Days from hours from parts of hours, for counts far beyond what a sketch holds exactly."""
    rows = spark.range(60_000).select((F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=(F.col("id") % 2880).cast("int"))).alias("ts"), F.concat(F.lit("u"), F.hash("id") % 20_000).alias("source_url"), (F.col("id") % 7).cast("string").alias("source_name"), F.lit("A").alias("country_code"), F.lit(1.0).alias("sentiment"))
    parts = sketches.sketched_hourly(rows.where("ts < '2024-01-01 05:30'"), ["country_code"]).unionByName(sketches.sketched_hourly(rows.where("ts >= '2024-01-01 05:30'"), ["country_code"]))
    got = {str(r.hour)[:10]: r for r in sketches.estimated(sketches.merged(parts, ["country_code"])).collect()}
    exact = {str(r.d)[:10]: r for r in rows.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("source_url").alias("urls")).collect()}
    for d, r in exact.items():
        assert got[d].signal_count == r.n and got[d].sources == 7 and got[d].avg_sentiment == 1.0
        assert abs(got[d].urls - r.urls) < 4 * 1.04 / math.sqrt(2**sketches.SIZE) * r.urls  # four standard errors
    whole = sketches.estimated(sketches.merged(sketches.sketched_hourly(rows, ["country_code"]), ["country_code"], "day"))
    assert {str(r.hour)[:10]: r.urls for r in whole.collect()} == {d: r.urls for d, r in got.items()}  # however the rows were cut


def test_grouping_sets_take_one_read(spark):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "A", None, 1.0, "s"), ("2024-01-01 02:00:00", "A", "x", 3.0, "t"), ("2024-01-01 02:00:00", None, "x", None, "t")], "ts string, a string, b string, sentiment double, source_name string").withColumn("ts", F.to_timestamp("ts"))
    made = rollups.grouped_sets(rows, [["a"], ["a", "b"], []], "day")
    plan = made._jdf.queryExecution().executedPlan().toString()
    got = {(r.kind, r.a, r.b): (r.signal_count, r.avg_sentiment, r.sources) for r in made.collect()}
    assert got == {("a", "A", None): (2, 2.0, 2), ("a", None, None): (1, None, 1), ("a,b", "A", None): (1, 1.0, 1), ("a,b", "A", "x"): (1, 3.0, 1), ("a,b", None, "x"): (1, None, 1), ("", None, None): (3, 2.0, 2)}
    assert plan.count("Scan ExistingRDD") == 1


@pytest.mark.parametrize("name", sorted(sql.SCALARS))
def test_sql_functions_agree_with_columns(spark, name):
    sql.register(spark)
    parameters, _, column = sql.SCALARS[name]
    pool = {"STRING": [None, "", "https://www.Example.com/a", "UK", "US", "social", "reddit_public", "state", "rch12", "AE12", "x'y"], "DOUBLE": [None, 0.0, -33.5, 150.25, 7.0], "BOOLEAN": [None, True, False]}
    rows = [tuple(RNG.choice(pool[k]) for k in parameters.values()) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k.lower()}" for n, k in parameters.items()))
    got = spark.sql(f"SELECT sw_{name}({', '.join(parameters)}) AS y FROM {{df}}", df=df).collect()
    assert [r.y for r in got] == [r.y for r in df.select(column().alias("y")).collect()]
