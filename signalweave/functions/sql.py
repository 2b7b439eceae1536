"""The library's functions for SQL: ``register`` makes them temporary functions of a session, scalar ones and ones that return tables.

Scalar functions are made from the same column expressions that operators use, so both always agree; only expressions without lambdas have a
form in SQL, so what takes lists apart is a function that returns a table, written in SQL. Names have a prefix, ``sw_`` by default.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import exprs, fixed

c = F.col
#: name: (parameters with types, result type, function that gives the column expression over the parameters)
SCALARS: dict = {}


def scalar(name: str, result: str, **parameters: str):
    def add(f):
        SCALARS[name] = (parameters, result, f)
        return f

    return add


scalar("domain", "STRING", url="STRING")(lambda: exprs.domain(c("url")))
scalar("iso_country", "STRING", fips="STRING")(lambda: exprs.iso_country(c("fips")))
scalar("haversine_km", "DOUBLE", lat1="DOUBLE", lon1="DOUBLE", lat2="DOUBLE", lon2="DOUBLE")(lambda: exprs.haversine_km(c("lat1"), c("lon1"), c("lat2"), c("lon2")))
scalar("signal_class", "STRING", family="STRING", method="STRING", state_media="BOOLEAN")(lambda: exprs.signal_class(c("family"), c("method"), c("state_media")))
scalar("aircraft_class", "STRING", callsign="STRING", icao24="STRING")(lambda: exprs.aircraft_class(c("callsign"), c("icao24")))
scalar("source_confidence", "DOUBLE", has_url="BOOLEAN", has_name="BOOLEAN", has_time="BOOLEAN")(lambda: exprs.source_confidence(c("has_url"), c("has_name"), c("has_time")))
scalar("conflict_intensity", "DOUBLE", goldstein="DOUBLE")(lambda: exprs.conflict_intensity(c("goldstein")))

#: name: (parameters, columns of the result, query)
TABLES = {
    "parse_locations": (
        "text STRING",
        "location_type INT, full_name STRING, country_code STRING, adm1 STRING, adm2 STRING, latitude DOUBLE, longitude DOUBLE, feature_id STRING, char_offset INT",
        """SELECT CAST(trim(p[0]) AS INT), trim(p[1]), trim(p[2]), trim(p[3]), trim(p[4]),
             CASE WHEN abs(try_cast(trim(p[5]) AS DOUBLE)) <= 90 THEN try_cast(trim(p[5]) AS DOUBLE) ELSE 0D END, CASE WHEN abs(try_cast(trim(p[6]) AS DOUBLE)) <= 180 THEN try_cast(trim(p[6]) AS DOUBLE) ELSE 0D END,
             coalesce(trim(get(p, 7)), ''), coalesce(try_cast(trim(get(p, 8)) AS INT), 0)
           FROM explode(transform(filter(split(coalesce(text, ''), ';'), b -> b RLIKE '^[ \\\\t]*[1-5][ \\\\t]*#' AND size(split(b, '#', -1)) >= 7), b -> split(b, '#', -1))) AS t(p)
           WHERE trim(p[1]) <> '' AND trim(p[2]) <> '' AND (trim(p[5]) = '' OR try_cast(trim(p[5]) AS DOUBLE) IS NOT NULL) AND (trim(p[6]) = '' OR try_cast(trim(p[6]) AS DOUBLE) IS NOT NULL)""",
    ),
    "parse_counts": (
        "text STRING",
        "count_type STRING, number BIGINT, object_type STRING, country_code STRING, latitude DOUBLE, longitude DOUBLE",
        """SELECT trim(p[0]), try_cast(trim(p[1]) AS BIGINT), coalesce(trim(get(p, 2)), ''), CASE WHEN size(p) >= 10 THEN trim(p[5]) END,
             CASE WHEN size(p) >= 10 THEN CASE WHEN abs(try_cast(trim(p[7]) AS DOUBLE)) <= 90 THEN try_cast(trim(p[7]) AS DOUBLE) ELSE 0D END END,
             CASE WHEN size(p) >= 10 THEN CASE WHEN abs(try_cast(trim(p[8]) AS DOUBLE)) <= 180 THEN try_cast(trim(p[8]) AS DOUBLE) ELSE 0D END END
           FROM explode(transform(split(coalesce(text, ''), ';'), b -> split(trim(b), '#', -1))) AS t(p)
           WHERE size(p) >= 2 AND trim(p[0]) <> '' AND try_cast(trim(p[1]) AS BIGINT) IS NOT NULL""",
    ),
    "countries_with_word": ("word STRING", "country_code STRING, place INT", None),
}


def _text(spark: SparkSession, parameters: dict[str, str], column: Column) -> str:
    """A column expression over the parameters as SQL."""
    empty = spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in parameters.items()])
    plan = empty.select(column.alias("y"))._jdf.queryExecution().analyzed()
    return plan.projectList().head().child().sql()


def register(spark: SparkSession, prefix: str = "sw_") -> list[str]:
    """Registers all functions in the session and gives their names."""
    made = []
    for name, (parameters, result, column) in SCALARS.items():
        given = ", ".join(f"{n} {t}" for n, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {result} RETURN CAST({_text(spark, parameters, column())} AS {result})")
        made.append(prefix + name)
    for name, (given, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS TABLE ({columns}) RETURN {query or _words()}")
        made.append(prefix + name)
    return made


def _words() -> str:
    """The table of country words as values: the countries that a word stands for, in the order in which they are tried."""
    quote = lambda x: "'" + x.replace("'", "\\'") + "'"
    rows = ", ".join(f"({i}, {quote(code)}, {quote(w.lower())})" for i, (code, words) in enumerate(fixed.COUNTRY_WORDS) for w in words.split(", "))
    return f"SELECT code, place FROM VALUES {rows} AS t(place, code, w) WHERE w = lower(word)"
