"""Themes, narratives, sources, countries: details, trends, comparisons, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from . import rollups as R
from .rollups import r, top_per


def trend(last: Column, previous: Column) -> Column:
    """A fifth more or less than the hour before; without one it is stable."""
    return F.when((previous > 0) & (last > previous * 1.2), "accelerating").when((previous > 0) & (last < previous * 0.8), "fading").otherwise("stable")


def narratives(S: DataFrame, as_of: str, hours: int, limit: int = 20, velocity_hours: float = 1, words: DataFrame | None = None, zipped: bool = False) -> DataFrame:
    """The most frequent themes with velocity, trend, spread over active countries, top countries and persons, daily timeline, first sight.

    Phase one picks ``limit`` themes; only their rows go on, by a semi-join with a table of that size, as (kind, value) pairs that are counted
    together: the signals are read twice. Active countries are counted as those of a further theme that every row has. ``words``
    (theme, interested) flags public interest. ``zipped`` pairs themes with persons by place, as a zipping unnest does.
    """
    any_theme = "\x00any"
    now = S.where(exprs.in_window(F.col("ts"), as_of, hours))
    themes = F.concat(F.coalesce("themes", F.array().cast("array<string>")), F.array(F.lit(any_theme)))
    flat = now.select("ts", "country_code", "source_name", "sentiment", "persons", F.posexplode(themes).alias("place", "theme"))
    top = flat.where(F.col("theme") != any_theme).groupBy("theme").agg(F.count("*").alias("signal_count"), r(F.avg("sentiment"), 4).alias("avg_sentiment")).orderBy(F.desc("signal_count"), "theme").limit(limit)
    about = ["theme", *top.columns[1:]]  # figures of a theme go along with it
    wanted = top.unionByName(S.sparkSession.createDataFrame([(any_theme,)], "theme string"), allowMissingColumns=True)
    people = F.when(F.col("place") < F.size("persons"), F.array(F.get("persons", F.col("place")))) if zipped else F.col("persons")
    one = lambda kind, value: _tagged(kind, F.array(value))
    pairs = F.concat(one("row", F.lit("")), one("country", F.col("country_code")), one("source", F.col("source_name")), one("day", F.date_format("ts", "MM-dd")), _tagged("person", people))
    pairs = F.when(F.col("theme") == any_theme, one("country", F.col("country_code"))).otherwise(pairs)
    rows = flat.drop("sentiment").join(F.broadcast(wanted), "theme").select(*about, "ts", F.explode(pairs).alias("p")).select(*about, "ts", "p.kind", "p.value").where("value is not null")
    recent = lambda a, b: F.count_if((F.col("kind") == "row") & exprs.in_window(F.col("ts"), as_of, a, b))
    counts = rows.groupBy(*about, "kind", "value").agg(F.count("*").alias("n"), recent(velocity_hours, 0).alias("velocity"), recent(2 * velocity_hours, velocity_hours).alias("before"), F.min("ts").alias("first_seen"))
    counts = counts.withColumn("rank", F.row_number().over(Window.partitionBy("theme", "kind").orderBy(F.desc("n"), "value")))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    first = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= 3), F.struct("rank", "value")))), lambda x: x["value"]), ",")
    parts = counts.groupBy(*about).agg(
        F.count(of("country", F.lit(1))).alias("country_count"), F.count(of("source", F.lit(1))).alias("source_count"), F.sum("velocity").alias("velocity"), F.sum("before").alias("before"), F.min(of("row", F.col("first_seen"))).alias("first_seen"),
        first("country").alias("top_countries"), first("person").alias("top_persons"), F.array_join(F.array_sort(F.collect_list(of("day", F.concat_ws(":", "value", "n")))), ",").alias("timeline"),
    )
    active = F.greatest(F.coalesce(F.max(F.when(F.col("theme") == any_theme, F.col("country_count"))).over(Window.partitionBy()), F.lit(1)), F.lit(1))  # at most ``limit`` + 1 rows
    if zipped:  # lists come from pairs then, and without a pair there is none
        parts = parts.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("top_countries", "top_persons")})
    joined = parts.withColumn("active", active).where(F.col("theme") != any_theme)
    if words is not None:
        joined = joined.join(words, "theme", "left").withColumn("interested", F.coalesce("interested", F.lit(False)))
    return joined.withColumn("trend", trend(F.col("velocity"), F.col("before"))).withColumn("spread_pct", F.round(100.0 * F.col("country_count") / F.col("active"), 1)).drop("active", "before")


def interest_flags(themes: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(theme, interested): whether a word of over three letters of a theme's label is in any of the texts (distinct ones, by pieces)."""
    words = themes.select("theme", F.explode(F.filter(F.split(F.lower(exprs.theme_label(F.col("theme"))), " "), lambda w: F.length(w) > 3)).alias("word"))
    found = texts.select(F.lower(text).alias("t")).distinct()
    hit = R.containing(found, "t", words, "word").select("theme").distinct().withColumn("interested", F.lit(True))
    return themes.select("theme").distinct().join(hit, "theme", "left").select("theme", F.coalesce("interested", F.lit(False)).alias("interested"))


def concept_summary(S: DataFrame, themes: list[str], as_of: str, hours: int) -> DataFrame:
    """Countries of a bundle of themes: rows, mean tone, first and last sight, up to five outlets."""
    rows = S.where(exprs.in_window(F.col("ts"), as_of, hours) & F.arrays_overlap("themes", F.array(*map(F.lit, themes))))
    return rows.groupBy("country_code").agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("tone"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_join(F.slice(F.array_sort(F.collect_set("source_name")), 1, 5), ",").alias("sources"))


def concepts_by_country(S: DataFrame, concepts: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Countries of every concept (slug, themes) at once: rows with any of its themes, mean tone, outlets. Rows meet concepts by a join on the theme."""
    members = concepts.select("slug", F.explode("themes").alias("theme"))
    rows = R.exploded(S.where(exprs.in_window(F.col("ts"), as_of, hours))).select("signal_id", "country_code", "sentiment", "source_name", "theme").join(members, "theme")
    once = rows.groupBy("slug", "signal_id").agg(*[F.any_value(c).alias(c) for c in ("country_code", "sentiment", "source_name")])
    return once.groupBy("slug", "country_code").agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("tone"), F.countDistinct("source_name").alias("sources"))


def concept_from_rollup(hourly: DataFrame, themes: list[str]) -> DataFrame:
    """The same from the theme-country-hour rollup, for long windows."""
    return R.weighted_tone(hourly.where(F.col("theme").isin(themes)), ["country_code"])


def related_themes(S: DataFrame, theme: str, limit: int = 10) -> DataFrame:
    rows = R.exploded(S.where(F.array_contains("themes", theme)), name="other").where(F.col("other") != theme)
    return rows.groupBy("other").agg(F.count("*").alias("n"), F.countDistinct("country_code").alias("countries")).orderBy(F.desc("n"), "other").limit(limit)


def theme_sources(S: DataFrame, theme: str, limit: int = 10) -> DataFrame:
    rows = S.where(F.array_contains("themes", theme))
    return rows.groupBy("source_name").agg(F.count("*").alias("n"), exprs.source_family(F.first("source_url")).alias("family"), r(F.avg("sentiment")).alias("tone")).orderBy(F.desc("n"), "source_name").limit(limit)


def framing_by_country(S: DataFrame, theme: str, sub: int = 3) -> DataFrame:
    """Per country the mean tone, its framing, and the themes that most often come with this one, in one window."""
    rows = S.where(F.array_contains("themes", theme))
    base = rows.groupBy("country_code").agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone"))
    others = R.exploded(rows, name="other").where(F.col("other") != theme).groupBy("country_code", "other").agg(F.count("*").alias("k"))
    top = top_per(others, ["country_code"], [F.desc("k"), F.asc("other")], sub).groupBy("country_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ",").alias("sub_themes"))
    return base.join(top, "country_code", "left").withColumn("framing", exprs.framing_label(F.col("tone")))


def theme_detail(S: DataFrame, theme: str, as_of: str, hours: int) -> dict[str, DataFrame]:
    now = S.where(exprs.in_window(F.col("ts"), as_of, hours))
    own = now.where(F.array_contains("themes", theme))
    return {
        "signals": own.orderBy(F.desc("ts"), "signal_id").limit(50),
        "sample": R.hourly_sample(own),
        "timeline": own.groupBy(R.hour().alias("hour")).agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone")),
        "countries": own.groupBy("country_code").agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone")),
        "related": related_themes(now, theme),
        "sources": theme_sources(now, theme),
        "persons": R.exploded(own, "persons", "person").groupBy("person").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person").limit(10),
        "framing": framing_by_country(now, theme),
    }


def theme_drift(S: DataFrame, theme: str, country: str | None = None) -> DataFrame:
    rows = S.where(F.array_contains("themes", theme))
    rows = rows if country is None else rows.where(F.col("country_code") == country)
    return rows.groupBy(R.day().alias("day")).agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("tone"))


def theme_spikes(S: DataFrame, theme: str, as_of: str | None = None, hours: int = 168, limit: int = 10) -> DataFrame:
    """Hours with the largest growth in percent over the hour of rows before, each with its first article that has a URL: URL, outlet, country, tone."""
    rows = S.where(F.array_contains("themes", theme))
    rows = rows if as_of is None else rows.where(exprs.in_window(F.col("ts"), as_of, hours))
    first = F.min_by(F.struct("source_url", "source_name", "country_code", F.round(F.coalesce("sentiment", F.lit(0.0)).try_cast("decimal(24,8)"), 3).cast("double").alias("sentiment")), F.when(F.col("source_url").isNotNull(), F.struct("ts", "signal_id")))
    hourly = rows.groupBy(F.lit(theme).alias("key"), R.hour().alias("hour")).agg(F.count("*").alias("signal_count"), first.alias("t"))
    grown = R.hourly_change(hourly, "key").where("delta > 0").withColumn("pct", F.round(F.col("delta").cast("decimal(20,0)") * 100 / F.col("previous"), 1).cast("double"))
    out = grown.select("hour", "signal_count", "previous", "pct", F.col("t.source_url").alias("trigger_url"), F.col("t.source_name").alias("trigger_source"), F.col("t.country_code").alias("trigger_country"), F.col("t.sentiment").alias("trigger_tone"))
    return out.orderBy(F.desc("pct"), "hour").limit(limit)


def theme_momentum(S: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """Each theme's rows in the last hours over those in as many before."""
    n = lambda a, b: F.count_if(exprs.in_window(F.col("ts"), as_of, a, b))
    rows = R.exploded(S.where(exprs.in_window(F.col("ts"), as_of, 2 * hours))).groupBy("theme").agg(n(hours, 0).alias("recent"), n(2 * hours, hours).alias("before"))
    ratio = F.try_divide(F.col("recent"), F.col("before"))
    return rows.withColumn("momentum", F.when(ratio >= 1.5, "accelerating").when(ratio <= 0.5, "declining").when(ratio.isNull() & (F.col("recent") > 0), "new").otherwise("steady"))


def focus_summary(S: DataFrame, kind: str, value: str, limit: int = 10) -> dict[str, DataFrame]:
    """Everything about a theme, person, country or source: countries, themes with it, outlets, newest headlines, people."""
    rows = S.where(exprs.focus(kind, value))
    top = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone")).orderBy(F.desc("n"), key).limit(limit)
    return {
        "nodes": rows.groupBy("country_code").agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone")),
        "themes": top(R.exploded(rows), "theme"),
        "sources": top(rows, "source_name"),
        "headlines": R.first_per(rows, [F.substring("source_url", 1, 30)], [F.desc("ts"), F.asc("signal_id")]).orderBy(F.desc("ts"), "signal_id").limit(limit),
        "people": top(R.exploded(rows, "persons", "person"), "person"),
    }


def top_lists(rows: DataFrame, key: str, kinds: dict[str, Column], n: int = 3) -> DataFrame:
    """One row a key with the ``n`` most frequent values of each kind (a name and an array of values), joined by commas.

    All kinds are counted in one pass: each row becomes (kind, value) pairs.
    """
    pairs = F.concat(*[_tagged(k, x) for k, x in kinds.items()])
    counts = rows.select(key, F.explode(pairs).alias("p")).where("p.value is not null").groupBy(key, "p.kind", "p.value").agg(F.count("*").alias("n"))
    ranked = top_per(counts, [key, "kind"], [F.desc("n"), F.asc("value")], n)
    lists = {k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "value")))), lambda x: x["value"]), ",") for k in kinds}
    return ranked.groupBy(key).agg(*[x.alias(k) for k, x in lists.items()])


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def country_detail(S: DataFrame, least_known: int = 50) -> DataFrame:
    """Each country's totals, top three themes, sources and persons, and share of foreign outlets where enough are known."""
    own = F.col("source_origin_country")
    base = S.groupBy("country_code").agg(F.count("*").alias("signal_count"), r(F.avg("sentiment")).alias("tone"), F.countDistinct("source_name").alias("sources"), F.when(F.count(own) > least_known, F.round(100.0 * F.count_if(own != F.col("country_code")) / F.count(own), 1)).alias("foreign_pct"))
    lists = top_lists(S, "country_code", {"top_themes": F.col("themes"), "top_sources": F.array("source_name"), "top_persons": F.col("persons")})
    return base.join(lists, "country_code", "left")


def source_profile(S: DataFrame, source: str, hourly: bool) -> dict[str, DataFrame]:
    rows = S.where(F.col("source_name") == source)
    return {
        "totals": rows.agg(F.count("*").alias("n"), F.countDistinct("country_code").alias("countries"), r(F.avg("sentiment")).alias("tone")),
        "themes": R.exploded(rows).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(10),
        "countries": rows.groupBy("country_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_code").limit(10),
        "timeline": rows.groupBy((R.hour() if hourly else R.day()).alias("at")).agg(F.count("*").alias("n")),
    }


def compare_periods(S: DataFrame, key: str, as_of: str, hours: int) -> DataFrame:
    """A window against the one before it, in one pass; change in percent is 0 where there was nothing."""
    a, b = exprs.in_window(F.col("ts"), as_of, hours), exprs.in_window(F.col("ts"), as_of, 2 * hours, hours)
    rows = S.where(exprs.in_window(F.col("ts"), as_of, 2 * hours)).groupBy(key).agg(F.count_if(a).alias("current"), F.count_if(b).alias("previous"), r(F.avg(F.when(a, F.col("sentiment"))) - F.avg(F.when(b, F.col("sentiment")))).alias("tone_delta"))
    return rows.withColumn("delta", F.col("current") - F.col("previous")).withColumn("pct", F.coalesce(R.two(100.0 * F.try_divide(F.col("delta"), F.col("previous"))), F.lit(0.0)))


def trend_series(rollup: DataFrame, keys: list[str], bucket: str, weighted: bool = False) -> DataFrame:
    """Rows and tone over time from an hourly rollup: the mean of means, or weighted by rows."""
    tone = F.try_divide(F.sum(F.col("avg_sentiment") * F.col("signal_count")), F.sum("signal_count")) if weighted else F.avg("avg_sentiment")
    return rollup.groupBy(*keys, F.date_trunc(bucket, "hour").alias("at")).agg(F.sum("signal_count").alias("signal_count"), R.exact(tone, 4).alias("tone"))


def briefing(S: DataFrame, as_of: str, hours: int, limit: int = 5, least: int = 10) -> dict[str, DataFrame]:
    now = S.where(exprs.in_window(F.col("ts"), as_of, hours))
    countries = now.groupBy("country_code").agg(F.count("*").alias("n"), r(F.avg("sentiment")).alias("tone"))
    themes = R.exploded(now)
    return {
        "countries": countries.orderBy(F.desc("n"), "country_code").limit(limit),
        "most_negative": countries.where(F.col("n") > least).orderBy("tone", "country_code").limit(limit),
        "most_positive": countries.where(F.col("n") > least).orderBy(F.desc("tone"), "country_code").limit(limit),
        "themes": themes.groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(limit),
        "sources": now.groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(limit),
        "stats": now.agg(F.count("*").alias("n"), F.countDistinct("country_code").alias("countries"), F.countDistinct("source_name").alias("sources")),
        "theme_countries": top_per(themes.groupBy("theme", "country_code").agg(F.count("*").alias("n")), ["theme"], [F.desc("n"), F.asc("country_code")], 4),
    }


def insight_facts(S: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row a theme with the numbers that a summary would be written from."""
    now = R.exploded(S.where(exprs.in_window(F.col("ts"), as_of, hours)))
    facts = now.groupBy("theme").agg(F.count("*").alias("n"), F.countDistinct("country_code").alias("countries"), F.countDistinct("source_name").alias("sources"), r(F.avg("sentiment")).alias("tone"), r(F.min("sentiment")).alias("lowest"), r(F.max("sentiment")).alias("highest"))
    return facts.join(theme_momentum(S, as_of).select("theme", "momentum"), "theme", "left")


def visible_persons(people: DataFrame, hidden: list[str] = (), limit: int = 8) -> DataFrame:
    """People (person, n) with two names or more who are not hidden, the most frequent first."""
    good = (F.size(F.split(F.trim("person"), r"\s+")) >= 2) & (F.col("n") > 0) & ~F.lower("person").isin(*(list(hidden) or [""]))
    return people.where(good).orderBy(F.desc("n"), "person").limit(limit)


def with_place(S: DataFrame, countries: DataFrame) -> DataFrame:
    """Signals with their own place, else their country's centre."""
    centre = countries.select("country_code", F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"))
    return S.join(centre, "country_code", "left").withColumn("latitude", F.coalesce("latitude", "lat0")).withColumn("longitude", F.coalesce("longitude", "lon0")).drop("lat0", "lon0")


def choose_source(hours: float, raw_up_to: float = 24.0, hourly_up_to: float = 168.0) -> str:
    """Which table answers a window: raw signals, the hourly rollup, or the daily one."""
    return "raw" if hours <= raw_up_to else "hourly" if hours <= hourly_up_to else "daily"


def totals_routed(S: DataFrame, hourly: DataFrame, daily: DataFrame, as_of: str, hours: float) -> DataFrame:
    """Rows a country in a window from the smallest table that has them."""
    table = choose_source(hours)
    if table == "raw":
        return S.where(exprs.in_window(F.col("ts"), as_of, hours)).groupBy("country_code").agg(F.count("*").alias("n"))
    rows, at = (hourly, "hour") if table == "hourly" else (daily, "day")
    return rows.where(exprs.in_window(F.col(at), as_of, hours)).groupBy("country_code").agg(F.sum("signal_count").alias("n"))
