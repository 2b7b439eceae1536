"""Rollups and aggregates over signals: hourly and daily tables, entropy, divergence, shares, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs


def r(x: Column, digits: int = 6) -> Column:
    """Rounded by way of exact decimals of ten places, halves away from zero.

    The last bits of a mean of doubles depend on the order of addition; ten places are the same in any order, so
    reruns and other engines round a mean on a half alike.
    """
    return F.round(x.try_cast("decimal(28,10)"), digits).cast("double")


def two(x: Column) -> Column:
    """Two places, halves away from zero, as for exact decimals."""
    return F.round(x.cast("decimal(24,8)"), 2).cast("double")


def exact(x: Column, digits: int) -> Column:
    """Like ``two`` with so many places: for means of figures that were rounded before."""
    return F.round(x.cast("decimal(24,10)"), digits).cast("double")


def hour(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def day(ts: str = "ts") -> Column:
    return F.date_trunc("day", F.col(ts))


def exploded(S: DataFrame, array: str = "themes", name: str = "theme", outer: bool = False) -> DataFrame:
    """A row for each element; with ``outer``, rows without elements stay, as ``__none__``."""
    if not outer:
        return S.withColumn(name, F.explode(array))
    return S.withColumn(name, F.explode_outer(array)).withColumn(name, F.coalesce(name, F.lit("__none__")))


def country_hourly(S: DataFrame) -> DataFrame:
    return S.groupBy("country_code", hour().alias("hour")).agg(
        F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("avg_sentiment"), r(F.min("sentiment")).alias("min_sentiment"), r(F.max("sentiment")).alias("max_sentiment"), F.countDistinct("source_name").alias("sources")
    )


def country_daily(S: DataFrame) -> DataFrame:
    return S.groupBy("country_code", day().alias("day")).agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("avg_sentiment"), F.countDistinct("source_name").alias("sources"))


def rollup_hourly(S: DataFrame, dim: Column) -> DataFrame:
    """Rows an hour and value of ``dim`` with the mean tone to two places."""
    return S.groupBy(hour().alias("hour"), dim.alias("dim")).agg(F.count("*").alias("signal_count"), two(F.avg("sentiment")).alias("avg_sentiment"))


def grouped_sets(S: DataFrame, sets: list[list[str]], unit: str = "hour") -> DataFrame:
    """Rollups by several sets of columns in one read and one shuffle: rows of each set with ``kind``, its columns joined by commas.

    Columns that are not of a row's set are null; so is a null value of the set itself, which ``kind`` tells apart. The empty set is all rows of the unit.
    """
    names = sorted({c for s in sets for c in s})
    rows = S.select(F.date_trunc(unit, "ts").alias("slot"), "sentiment", "source_name", *[F.col(c).alias(f"by_{c}") for c in names])
    per = rows.groupingSets([[F.col("slot"), *[F.col(f"by_{c}") for c in s]] for s in sets], F.col("slot"), *[F.col(f"by_{c}") for c in names])
    kind = F.concat_ws(",", *[F.when(F.grouping(f"by_{c}") == 0, F.lit(c)) for c in names])
    made = per.agg(kind.alias("kind"), F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("avg_sentiment"), F.countDistinct("source_name").alias("sources"))
    return made.withColumnsRenamed({f"by_{c}": c for c in names})


def theme_hourly(S: DataFrame) -> DataFrame:
    return exploded(S).groupBy("theme", hour().alias("hour")).agg(
        F.count("*").alias("signal_count"), F.countDistinct("country_code").alias("countries"), F.countDistinct("source_name").alias("sources"), r(F.avg("sentiment")).alias("avg_sentiment"), F.count("nlp_sentiment").alias("nlp_count"), r(F.avg("nlp_sentiment")).alias("nlp_avg")
    )


def theme_country_hourly(S: DataFrame) -> DataFrame:
    return exploded(S).groupBy("theme", "country_code", hour().alias("hour")).agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("avg_sentiment"), F.count("nlp_sentiment").alias("nlp_count"), r(F.avg("nlp_sentiment")).alias("nlp_avg"))


def theme_daily(S: DataFrame) -> DataFrame:
    return exploded(S).groupBy("theme", day().alias("day")).agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("avg_sentiment"), F.countDistinct("country_code").alias("countries"))


def theme_mentions(S: DataFrame, mentions: Column) -> DataFrame:
    """Theme hours with summed mentions; rows without themes count as GENERAL."""
    rows = S.withColumn("m", mentions).withColumn("theme", F.explode_outer("themes")).withColumn("theme", F.coalesce("theme", F.lit("GENERAL")))
    return rows.groupBy("theme", "country_code", hour().alias("hour")).agg(F.count("*").alias("events"), F.sum("m").alias("mentions"), r(F.avg("sentiment")).alias("avg_tone"))


def daily_from_hourly(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("theme", "country_code", F.date_trunc("day", "hour").alias("day")).agg(F.sum("events").alias("events"), F.sum("mentions").alias("mentions"), exact(F.avg("avg_tone"), 4).alias("avg_tone"))


def merge_aggregates(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two partial aggregates (n, total, low, high) by key as one, with the mean."""
    both = old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return both.withColumn("mean", r(F.try_divide("total", "n"))).drop("total")


def partials(S: DataFrame, keys: list[str], value: str = "sentiment") -> DataFrame:
    return S.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def weighted_tone(rollup: DataFrame, keys: list[str], tone: str = "avg_sentiment", n: str = "signal_count") -> DataFrame:
    """The mean of means, weighted by rows; 0 without rows."""
    return rollup.groupBy(*keys).agg(F.sum(n).alias("signal_count"), r(F.coalesce(F.try_divide(F.sum(F.col(tone) * F.col(n)), F.sum(n)), F.lit(0.0))).alias("tone"))


def entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Shannon entropy (natural) of a category by key, over its maximum; 0 for one kind. Null categories are left out."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N, so one aggregate of the counts is enough
    n = F.sum("n")
    h = F.log(n) - F.sum(F.col("n") * F.log("n")) / n
    return counts.groupBy(*keys).agg(n.alias("total"), F.count("*").alias("kinds"), h.alias("h")).select(*keys, "total", "kinds", F.greatest(F.col("h"), F.lit(0.0)).alias("entropy"), F.when(F.col("kinds") > 1, F.col("h") / F.log("kinds")).otherwise(0.0).alias("evenness"))


def kl_vs_global(df: DataFrame, key: str, category: str, floor: float = 1e-9) -> DataFrame:
    """Divergence of each key's mix of a category from the mix of all rows, whatever their key."""
    whole = df.groupBy(category).agg(F.count("*").alias("all_n"))
    total = whole.agg(F.sum("all_n").alias("all_total"))
    own = df.where(F.col(key).isNotNull()).groupBy(key, category).agg(F.count("*").alias("n"))
    totals = own.groupBy(key).agg(F.sum("n").alias("own_total"))
    p, q = F.col("n") / F.col("own_total"), F.col("all_n") / F.col("all_total")
    # one row with the total of all
    rows = own.join(totals, key).join(whole, category).join(F.broadcast(total))
    return rows.groupBy(key).agg(F.sum(p * F.log(F.greatest(p / q, F.lit(floor)))).alias("kl"))


def geo_grid(S: DataFrame, step: float = 0.1, least: int = 3) -> DataFrame:
    cell = lambda c: r(F.round(F.col(c) / step) * step)
    rows = exploded(S).groupBy(cell("latitude").alias("lat"), cell("longitude").alias("lon"))
    return rows.agg(F.countDistinct("signal_id").alias("signal_count"), r(F.avg("sentiment")).alias("avg_sentiment"), F.array_sort(F.collect_set("theme")).alias("themes")).where(F.col("signal_count") >= least)


def heat_points(S: DataFrame) -> DataFrame:
    """Rows a point, with their number over the largest one."""
    points = S.groupBy("latitude", "longitude").agg(F.count("*").alias("n"))
    return points.join(F.broadcast(points.agg(F.max("n").alias("top")))).select("latitude", "longitude", "n", r(F.try_divide("n", "top")).alias("intensity"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    return groups.join(F.broadcast(groups.agg(F.sum("n").alias("all_n")))).select(key, "n", F.round(100.0 * F.col("n") / F.col("all_n"), 2).alias("pct"))


def seen_span(S: DataFrame, key: str = "theme") -> DataFrame:
    return S.groupBy(key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def duplicate_clusters(S: DataFrame) -> DataFrame:
    found = S.where("source_url is not null").groupBy(F.md5("source_url").alias("url_hash")).agg(F.count("*").alias("n"), F.countDistinct("source_name").alias("outlets"), F.min("ts").alias("first_seen"))
    return found.where("n > 1")


def source_health(S: DataFrame, key: str) -> DataFrame:
    """Concentration (largest outlet's percentage), and stand-ins for diversity and quality that follow from it."""
    per = S.groupBy(key, "source_name").agg(F.count("*").alias("n"))
    rows = per.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("outlets"), F.max("n").alias("most"))
    pct = 100.0 * F.col("most") / F.col("total")
    return rows.select(key, "total", "outlets", r(pct).alias("concentration"), r(F.least(F.lit(100.0), 50.0 * F.col("outlets") / F.sqrt("total"))).alias("diversity"), r(F.greatest(F.lit(0.0), 100.0 - 1.5 * pct)).alias("quality"))


# Windows, top-k, sets


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def hourly_sample(S: DataFrame, per_hour: int = 8, limit: int = 240) -> DataFrame:
    """The newest rows of each hour, then the oldest of these."""
    rows = top_per(S.withColumn("hour", hour()), ["hour"], [F.desc("ts"), F.asc("signal_id")], per_hour)
    return rows.orderBy("ts", "signal_id").limit(limit)


def stratified_sample(S: DataFrame, keys: list[str], per: int = 3, newest: int = 75_000) -> DataFrame:
    """The newest few rows of each day and combination of keys, among the ``newest`` rows of all."""
    S = S.orderBy(F.desc("ts"), "signal_id").limit(newest)
    return top_per(S.withColumn("day", day()), ["day", *keys], [F.desc("ts"), F.asc("signal_id")], per)


def hourly_change(hourly: DataFrame, key: str, n: str = "signal_count") -> DataFrame:
    before = F.lag(n).over(Window.partitionBy(key).orderBy("hour"))
    return hourly.withColumn("previous", before).withColumn("delta", F.col(n) - F.col("previous")).withColumn("pct", F.round(100.0 * F.try_divide(F.col("delta"), F.col("previous")), 2))


def stance_drift(stances: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Each row with the one before it of its keys: the label changed, and by how much the score moved."""
    w = Window.partitionBy(*keys).orderBy("ts", "signal_id")
    return stances.withColumn("previous_label", F.lag(label).over(w)).withColumn("previous_score", F.lag(score).over(w)).withColumn("changed", F.coalesce(F.col("previous_label") != F.col(label), F.lit(False))).withColumn("drift", r(F.abs(F.col(score) - F.col("previous_score"))))


def first_per(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key, null keys left out."""
    named = [f"__k{i}" for i in range(len(keys))]
    rows = df.withColumns(dict(zip(named, keys)))
    for n in named:
        rows = rows.where(F.col(n).isNotNull())
    return top_per(rows, named, order, 1, "__r").drop(*named, "__r")


def dedup_urls(S: DataFrame, keep_null_urls: bool = False) -> DataFrame:
    """One row a URL, the lowest id; rows without a URL go unless they are kept."""
    rows = first_per(S, [F.col("source_url")], [F.asc("signal_id")])
    return rows.unionByName(S.where("source_url is null")) if keep_null_urls else rows


def dedup_titles(S: DataFrame, title: str = "headline") -> DataFrame:
    return first_per(S, [F.lower(exprs.clean_title(F.col(title)))], [F.asc("signal_id")])


def merged_lists(lists: list[DataFrame], key: str, order: str, limit: int) -> DataFrame:
    """Several lists as one, the first occurrence of a key stays, in order."""
    rows = lists[0].withColumn("list_no", F.lit(0))
    for i, x in enumerate(lists[1:], 1):
        rows = rows.unionByName(x.withColumn("list_no", F.lit(i)))
    first = top_per(rows, [key], [F.asc("list_no"), F.asc(order)], 1, "__r").drop("__r")
    return first.orderBy("list_no", order, key).limit(limit)


def duplication_index(S: DataFrame, key: str) -> DataFrame:
    return S.where("headline is not null").groupBy(key).agg((1 - F.countDistinct(F.lower("headline")) / F.count("*")).alias("duplication"))


def grouped_top(df: DataFrame, group: str, n: str = "signal_count", last: str = "other") -> DataFrame:
    """Groups by their totals, one of them always at the end."""
    return df.groupBy(group).agg(F.sum(n).alias("total")).orderBy(F.when(F.col(group) == last, 1).otherwise(0), F.desc("total"), group)


def containing(texts: DataFrame, text: str, words: DataFrame, word: str, most: int = 4) -> DataFrame:
    """Texts joined with the words that they contain, by an equi-join on a word's first letters (up to ``most``).

    Every piece of that length of a text is a key, so only texts that have the beginning of a word meet it; the test
    for the whole word follows. No nested loop over words and texts.
    """
    t = F.col(text)
    pieces = F.flatten(F.array(*[F.when(F.length(t) >= n, _pieces(t, n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]))
    keyed = texts.withColumn("__piece", F.explode(F.array_distinct(pieces)))
    begun = words.where(F.length(word) > 0).withColumn("__piece", F.substring(F.col(word), 1, most))
    return keyed.join(begun, "__piece").where(t.contains(F.col(word))).drop("__piece")


def _pieces(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
