"""Joins of points with places by distance, each place with a radius of its own.

A place has a level: cells whose height is the first power of two of degrees that is no less than its radius. Cells go in bands of
latitude, with fewer of them in a band the nearer it is to a pole, so that they stay about square. A place covers a few cells of its
level: the bands within its radius, in each those that its circle reaches, around the date line too, and whole bands if it holds a pole. A point is in one
cell of each level that there is. So a point meets only places whose cells it is in, and each of them once; the distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from .rollups import top_per

KM_A_DEGREE = 6371.0 * 3.141592653589793 / 180.0
LEVELS = (-8, 7)  # powers of two of degrees


def _cells(band: Column, size: Column) -> Column:
    """How many cells a band has: by its longest parallel."""
    south, north = band * size - 90.0, (band + 1) * size - 90.0
    nearest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(north)))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(nearest)) / size), F.lit(1))


def _valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def covered(places: DataFrame, km: str = "km") -> DataFrame:
    """The places with the cells (level, band, cell) that their circles may reach."""
    reach = F.col(km) / KM_A_DEGREE * (1 + 1e-9) + 1e-9
    level = F.greatest(F.least(F.ceil(F.log2(reach)), F.lit(LEVELS[1])), F.lit(LEVELS[0])).cast("int")
    rows = _valid(places).where(F.col(km) >= 0).withColumn("__d", reach).withColumn("level", level).withColumn("__s", F.pow(F.lit(2.0), "level"))
    low, high = F.greatest(F.col("latitude") - F.col("__d"), F.lit(-90.0)), F.least(F.col("latitude") + F.col("__d"), F.lit(90.0))
    rows = rows.withColumn("band", F.explode(F.sequence(F.floor((low + 90.0) / F.col("__s")), F.floor((high + 90.0) / F.col("__s")))))
    rows = rows.withColumn("__n", _cells(F.col("band"), F.col("__s")))
    pole = (F.col("latitude") + F.col("__d") >= 90.0) | (F.col("latitude") - F.col("__d") <= -90.0)
    wide = F.degrees(F.asin(F.least(F.sin(F.radians("__d")) / F.cos(F.radians("latitude")), F.lit(1.0)))) * (1 + 1e-9) + 1e-9
    at = lambda x: F.floor((F.col("longitude") + 180.0 + x) / 360.0 * F.col("__n"))
    some = F.array_distinct(F.transform(F.sequence(at(-wide), F.least(at(wide), at(-wide) + F.col("__n") - 1)), lambda x: F.pmod(x, F.col("__n"))))
    every = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
    return rows.withColumn("cell", F.explode(F.when(pole, every).otherwise(some))).drop("__d", "__s", "__n")


def within_radius(points: DataFrame, places: DataFrame, place: str = "place", km: str = "km") -> DataFrame:
    """Points (latitude, longitude, ...) with each place (``place``, latitude, longitude, ``km``) whose radius they are in, and their ``distance``.

    Rows without a valid place on either side go.
    """
    cells = covered(places.select(place, "latitude", "longitude", km), km).withColumnsRenamed({"latitude": "__lat", "longitude": "__lon", km: "__km"})
    levels = places.where(F.col(km) >= 0).agg(F.array_sort(F.collect_set(F.greatest(F.least(F.ceil(F.log2(F.col(km) / KM_A_DEGREE * (1 + 1e-9) + 1e-9)), F.lit(LEVELS[1])), F.lit(LEVELS[0])).cast("int"))).alias("__levels"))
    size = F.pow(F.lit(2.0), "level")
    rows = _valid(points).join(F.broadcast(levels), F.lit(True)).withColumn("level", F.explode("__levels")).drop("__levels")  # one row of at most 16 levels
    rows = rows.withColumn("band", F.floor((F.col("latitude") + 90.0) / size))
    n = _cells(F.col("band"), size)
    rows = rows.withColumn("cell", F.pmod(F.floor((F.col("longitude") + 180.0) / 360.0 * n), n))
    distance = exprs.haversine_km(F.col("latitude"), F.col("longitude"), F.col("__lat"), F.col("__lon"))
    met = rows.join(cells, ["level", "band", "cell"]).withColumn("distance", distance).where(F.col("distance") <= F.col("__km"))
    return met.drop("level", "band", "cell", "__lat", "__lon", "__km")


def nearest_place(points: DataFrame, places: DataFrame, key: str, place: str = "place", km: str = "km") -> DataFrame:
    """Of the places whose radius a point is in the nearest, ties by the smaller name; ``key`` tells points apart. Points without one go."""
    return top_per(within_radius(points, places, place, km), [key], [F.asc("distance"), F.asc(place)], 1).drop("rank")
