"""Pairs and graphs: attention overlap of countries, correlations, topic flows, hotspots, narrative graphs, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from . import rollups as R
from .rollups import r, top_per


def shared_pairs(sets: DataFrame, owner: str, element: str, names: int = 0) -> DataFrame:
    """(a, b, shared) for a < b: owners that have elements in common, by a join on the element, and how many.

    No pair without a common element is made, and equal elements of a hot owner meet in partial counts. With ``names``, the first so
    many common elements come too; sets should be small then.
    """
    left, right = sets.select(F.col(owner).alias("a"), element), sets.select(F.col(owner).alias("b"), element)
    named = [F.slice(F.array_sort(F.collect_list(element)), 1, names).alias("names")] if names else []
    return left.join(right, element).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), *named)


def jaccard_pairs(sets: DataFrame, owner: str, element: str, names: int = 0) -> DataFrame:
    sizes = sets.groupBy(owner).agg(F.count("*").alias("n"))
    a, b = (sizes.select(F.col(owner).alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    rows = shared_pairs(sets, owner, element, names).join(a, "a").join(b, "b")
    return rows.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))


def theme_flows(S: DataFrame, as_of: str, hours: float = 6, least_theme: int = 2, least_total: int = 5, top: int = 30, min_jaccard: float = 0.2, min_shared: int = 3, limit: int = 100, focus: tuple[str, str] | None = None, countries: DataFrame | None = None) -> DataFrame:
    """Countries whose most frequent themes overlap; strength is the overlap times the smaller volume over ten.

    With a focus (kind, value) only rows about it count, and three of them are enough. With ``countries`` only those with a place have flows,
    which then carry both places. Up to five of the shared themes are named.
    """
    if focus:
        kind, value = focus
        S, least_total = S.where(exprs.focus(kind, value.upper() if kind in ("theme", "country") else value)), min(least_total, 3)
    counts = R.exploded(S.where(exprs.in_window(F.col("ts"), as_of, hours) & F.col("country_code").isNotNull())).groupBy("country_code", "theme").agg(F.count("*").alias("n")).where(F.col("n") >= least_theme)
    # one row a country: its most frequent themes, at most ``top``, with the total of all
    own = Window.partitionBy("country_code")
    ranked = top_per(counts.withColumn("total", F.sum("n").over(own)), ["country_code"], [F.desc("n"), F.asc("theme")], top).where(F.col("total") >= least_total)
    sets = ranked.groupBy("country_code").agg(F.max("total").alias("total"), F.collect_list("theme").alias("ts"))
    made, carried = [], ["total", "size"]
    if countries is not None:
        sets = sets.join(countries.where("latitude is not null").select("country_code", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "country_code")
        made, carried = ["lat_a", "lon_a", "lat_b", "lon_b"], [*carried, "lat", "lon"]
    side = lambda x: sets.withColumn("size", F.size("ts")).select(F.col("country_code").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in carried], F.explode("ts").alias("theme"))
    met = side("a").join(side("b"), "theme").where("a < b").groupBy("a", "b", *[f"{c}_{x}" for c in carried for x in ("a", "b")])
    rows = met.agg(F.count("*").alias("shared"), F.slice(F.array_sort(F.collect_list("theme")), 1, 5).alias("names"))
    rows = rows.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).where((F.col("jaccard") >= min_jaccard) & (F.col("shared") >= min_shared))
    strength = R.two(F.col("jaccard") * F.least("total_a", "total_b") / 10.0)
    return rows.select("a", "b", strength.alias("strength"), F.round("jaccard", 3).alias("similarity"), "shared", F.array_join("names", ",").alias("themes"), *made).orderBy(F.desc("strength"), "a", "b").limit(limit)


def theme_correlation(S: DataFrame, top: int = 10) -> DataFrame:
    """Co-occurrence of the most frequent themes as (a, b, jaccard) for a < b, pairs within a row only."""
    flat = R.exploded(S.select("signal_id", F.array_distinct("themes").alias("themes")))
    counts = flat.groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(top)
    names = F.broadcast(counts.select("theme"))  # ``top`` rows
    kept = flat.join(names, "theme", "left_semi").groupBy("signal_id").agg(F.array_sort(F.collect_list("theme")).alias("ts"))
    pair = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = kept.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    a, b = (counts.select(F.col("theme").alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    every = a.join(b, F.col("a") < F.col("b"))  # of ``top`` names
    rows = every.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return rows.select("a", "b", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 3).alias("jaccard"))


def row_pairs(S: DataFrame, array: str) -> DataFrame:
    """(a, b, n) for a < b: in how many rows both are elements of the array. Pairs are made within a row, so nothing is joined."""
    ts = F.array_sort(F.array_distinct(F.array_compact(array)))
    both = lambda ts: F.flatten(F.transform(ts, lambda a: F.transform(F.filter(ts, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return S.select(F.explode(exprs.once(ts, both)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def country_correlation(S: DataFrame, top: int = 10) -> DataFrame:
    """Overlap of theme sets of the countries with most rows."""
    names = S.groupBy("country_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_code").limit(top)
    sets = R.exploded(S.join(F.broadcast(names.select("country_code")), "country_code", "left_semi")).select("country_code", "theme").distinct()
    return jaccard_pairs(sets, "country_code", "theme").select("a", "b", F.round("jaccard", 3).alias("jaccard"))


def pivoted(pairs: DataFrame, names: list[str]) -> DataFrame:
    """A correlation list as a square table of the given names."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    return both.groupBy("a").pivot("b", names).agg(F.first("jaccard"))


# Topic flows

STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with"]


def term_counts(topics: DataFrame, label: str, stop_words: list[str], carry: list[str]) -> DataFrame:
    """(topic_id, carried columns, term, tf): the words of labels without stop words, and pairs of neighbours among these."""
    words = F.filter(exprs.tokens(F.col(label)), lambda w: (F.length(w) > 1) & ~w.isin(stop_words))
    pairs = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    terms = topics.withColumn("ws", words).select("topic_id", *carry, F.explode(F.array_compact(F.concat("ws", pairs(F.col("ws"))))).alias("term"))
    return terms.groupBy("topic_id", *carry, "term").agg(F.count("*").alias("tf"))


def term_vectors(topics: DataFrame, label: str = "label", stop_words: list[str] = STOP_WORDS, carry: list[str] = ()) -> DataFrame:
    """Unit TF-IDF vectors of labels over words and pairs of neighbours: (topic_id, carried columns, term, w, df). idf = ln((1 + n) / (1 + df)) + 1."""
    tf = term_counts(topics, label, stop_words, carry)
    n = topics.agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("topic_id")))
    return weights.select("topic_id", *carry, "term", (F.col("w") / norm).alias("w"), "df")


def topic_flows(topics: DataFrame, halflife: float = 6.0, threshold: float = 0.3, window_hours: float = 24.0, shared: int = 3) -> DataFrame:
    """From earlier to later countries: the best cosine of their topics times exp(-hours / halflife), if over ``threshold``.

    topics: topic_id, country_code, label, ts (one time a country). Topics only meet by terms of their prefixes: in the order from rare to
    frequent terms, what stands after the prefix is too short a vector to reach the threshold alone, so of two topics that
    reach it the rarest common term is in both prefixes. Very frequent terms thus bring few topics together. What meets is compared by whole vectors.
    """
    carry = ["country_code", "ts", "label"]
    v = term_vectors(topics, carry=carry)
    after = F.coalesce(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("topic_id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))
    whole = Window.partitionBy("topic_id").orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keyed = v.withColumn("after", after).withColumn("vector", F.collect_list(F.struct("term", "w")).over(whole)).where(F.sqrt("after") >= threshold * (1 - 1e-9)).select("topic_id", *carry, "term", "vector")
    a, b = (keyed.select("term", *[F.col(c).alias(f"{c}_{x}") for c in ("topic_id", *carry, "vector")]) for x in ("a", "b"))
    earlier = (F.col("ts_a") < F.col("ts_b")) | ((F.col("ts_a") == F.col("ts_b")) & (F.col("country_code_a") < F.col("country_code_b")))
    hours = (F.col("ts_b").cast("double") - F.col("ts_a").cast("double")) / 3600.0
    met = a.join(b, "term").where(earlier & (F.col("country_code_a") != F.col("country_code_b")) & (hours <= window_hours))
    met = met.groupBy("topic_id_a", "topic_id_b").agg(*[F.any_value(f"{c}_{x}").alias(f"{c}_{x}") for x in ("a", "b") for c in (*carry, "vector")])
    weight = F.map_from_entries("vector_b")
    dot = exprs.once(weight, lambda m: F.aggregate("vector_a", F.lit(0.0), lambda acc, e: acc + e["w"] * F.coalesce(F.try_element_at(m, e["term"]), F.lit(0.0))))
    dots = met.withColumn("cosine", dot)
    pairs = dots.groupBy("country_code_a", "country_code_b").agg(F.max("cosine").alias("similarity"), F.min("ts_a").alias("ts_a"), F.min("ts_b").alias("ts_b"), F.slice(F.array_sort(F.collect_set(F.when(F.col("cosine") >= threshold, F.col("label_a")))), 1, shared).alias("topics"))
    heat = F.col("similarity") * exprs.decay(F.col("ts_a"), F.col("ts_b"), halflife)
    return pairs.withColumn("heat", r(heat)).where(F.col("heat") >= threshold).select(F.col("country_code_a").alias("source"), F.col("country_code_b").alias("target"), r(F.col("similarity")).alias("similarity"), "heat", F.array_join("topics", ",").alias("topics"))


def _follows(a: str, b: str, window_hours: float) -> Column:
    """Topic a is of another country than b, which comes later, within the window."""
    earlier = (F.col(f"ts_{a}") < F.col(f"ts_{b}")) | ((F.col(f"ts_{a}") == F.col(f"ts_{b}")) & (F.col(f"country_code_{a}") < F.col(f"country_code_{b}")))
    hours = (F.col(f"ts_{b}").cast("double") - F.col(f"ts_{a}").cast("double")) / 3600.0
    return earlier & (F.col(f"country_code_{a}") != F.col(f"country_code_{b}")) & (hours <= window_hours)


def _sides(rows: DataFrame, key: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(key, *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in ("a", "b"))


def overlap_matches(topics: DataFrame, threshold: float, window_hours: float = 24.0) -> DataFrame:
    """Pairs of topics whose stems overlap: common ones over those of the shorter label, at least ``threshold``.

    Stems: words between white space, without "ing" (over 5 letters) or else a last "s" (over 3), of 3 letters or more. What
    reaches the threshold has one of the rarest stems of the shorter label in common: its prefix meets all stems of longer ones.
    """
    cut = lambda w: F.when(w.endswith("ing") & (F.length(w) > 5), w.substr(F.lit(1), F.length(w) - 3)).when(w.endswith("s") & (F.length(w) > 3), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)
    stems = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.trim("label")), r"\s+"), cut), lambda w: F.length(w) > 2))
    carry = ["topic_id", "country_code", "ts", "label"]
    words = topics.select(*carry, F.explode(stems).alias("word"))
    ordered = words.join(words.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy(*carry).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("ws"))
    n = F.size("ws")
    reach = n - F.ceil(n * threshold - 1e-9) + 1
    every = ordered.select(*carry, "ws", F.explode("ws").alias("word"))
    first = ordered.select(*carry, "ws", F.explode(F.slice("ws", 1, F.greatest(reach, F.lit(1)).cast("int"))).alias("word"))
    short, long = _sides(first, "word", *carry, "ws")[0], _sides(every, "word", *carry, "ws")[1]
    sizes = (F.size("ws_a") < F.size("ws_b")) | ((F.size("ws_a") == F.size("ws_b")) & (F.col("topic_id_a") < F.col("topic_id_b")))
    common = F.array_intersect("ws_a", "ws_b")
    # a pair is told at its rarest common stem alone
    met = short.join(long, "word").where(sizes & (_follows("a", "b", window_hours) | _follows("b", "a", window_hours))).where(F.col("word") == F.element_at(common, 1))
    met = met.withColumn("score", F.size(common) / F.size("ws_a")).where(F.col("score") >= threshold)
    ahead = _follows("a", "b", window_hours)
    turned = [F.when(ahead, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for c in carry for x, y in (("a", "b"), ("b", "a"))]
    return met.select(*turned, "score")


def pair_cosine_matches(topics: DataFrame, threshold: float, window_hours: float = 24.0, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Pairs of topics whose TF-IDF cosine is at least ``threshold``, where the documents of IDF are the topics of their two countries alone.

    A term's weight thus differs from pair to pair; it lies between bounds that hold for any other country, and these bound what the
    terms after a prefix can add. Pairs whose rarest common term is in both prefixes get their weights, by one join of the terms with the other country's counts.
    """
    carry = ["country_code", "ts", "label"]
    tf = term_counts(topics, "label", stop_words, carry)
    own = tf.groupBy("country_code", "term").agg(F.count("*").alias("d"))
    every = own.groupBy("term").agg(F.sum("d").alias("df"), F.max("d").alias("most"))
    sizes = topics.groupBy("country_code").agg(F.count("*").alias("n"))
    ends = sizes.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    v = tf.join(own.join(every, "term"), ["country_code", "term"]).join(sizes, "country_code").join(F.broadcast(ends))  # one row
    low_n = F.col("n") + F.col("n_min")
    high = F.col("tf") * (F.log((1 + F.col("n") + F.col("n_max")) / (1 + F.col("d"))) + 1)
    low = F.col("tf") * (F.greatest(F.lit(0.0), F.log((1 + low_n) / (1 + F.least(F.col("d") + F.col("most"), low_n)))) + 1)
    rare = Window.partitionBy("topic_id").orderBy("df", "term")
    after = F.sum(high * high).over(rare.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.coalesce(F.sum(low * low).over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    vector = F.collect_list(F.struct("term", "tf", "d")).over(rare.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keyed = v.select("topic_id", *carry, "n", "term", after.alias("after"), before.alias("before"), vector.alias("vector")).where(F.col("after") >= threshold * threshold * (1 - 1e-9) * (F.col("after") + F.col("before")))
    a, b = _sides(keyed, "term", "topic_id", *carry, "n", "vector")
    terms = lambda x: F.transform(f"vector_{x}", lambda e: e["term"])
    met = a.join(b, "term").where(_follows("a", "b", window_hours)).where(F.col("term") == F.element_at(F.array_intersect(terms("a"), terms("b")), 1)).withColumn("docs", F.col("n_a") + F.col("n_b")).drop("term")
    idf = lambda d: F.log((1 + F.col("docs")) / (1 + d)) + 1
    other = F.map_from_arrays(terms("b"), F.col("vector_b"))

    def product(m):
        return F.aggregate("vector_a", F.lit(0.0), lambda acc, e: acc + F.coalesce(e["tf"] * F.try_element_at(m, e["term"])["tf"] * F.pow(idf(e["d"] + F.try_element_at(m, e["term"])["d"]), 2), F.lit(0.0)))

    dots = met.withColumn("dot", exprs.once(other, product))
    lengths = {}
    for x, y in (("a", "b"), ("b", "a")):
        seen = met.select(f"topic_id_{x}", f"country_code_{y}", f"vector_{x}", "docs").dropDuplicates([f"topic_id_{x}", f"country_code_{y}"]).select(f"topic_id_{x}", f"country_code_{y}", "docs", F.inline(f"vector_{x}"))
        theirs = own.select(F.col("country_code").alias(f"country_code_{y}"), "term", F.col("d").alias("d_other"))
        weight = F.col("tf") * idf(F.col("d") + F.coalesce("d_other", F.lit(0)))
        lengths[x] = seen.join(theirs, [f"country_code_{y}", "term"], "left").groupBy(f"topic_id_{x}", f"country_code_{y}").agg(F.sqrt(F.sum(weight * weight)).alias(f"length_{x}"))
    scored = dots.join(lengths["a"], ["topic_id_a", "country_code_b"]).join(lengths["b"], ["topic_id_b", "country_code_a"]).withColumn("score", F.least(F.lit(1.0), F.col("dot") / (F.col("length_a") * F.col("length_b"))))
    return scored.where(F.col("score") >= threshold).select(*[f"{c}_{x}" for c in ("topic_id", *carry) for x in ("a", "b")], "score")


def pair_flows(topics: DataFrame, halflife: float = 6.0, threshold: float = 0.1, window_hours: float = 24.0, shared: int = 3, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Flows from earlier to later countries by their best pair of topics, by cosine within the pair of countries or by overlap of stems.

    topics as in ``topic_flows``. Heat is the better of both times exp(-hours / halflife); as it is at most the similarity, pairs of topics under ``threshold`` never matter.
    """
    hits = pair_cosine_matches(topics, threshold, window_hours, stop_words).unionByName(overlap_matches(topics, threshold, window_hours))
    pairs = hits.groupBy("country_code_a", "country_code_b").agg(F.max("score").alias("similarity"), F.min("ts_a").alias("ts_a"), F.min("ts_b").alias("ts_b"), F.slice(F.array_sort(F.collect_set("label_a")), 1, shared).alias("topics"))
    heat = F.col("similarity") * exprs.decay(F.col("ts_a"), F.col("ts_b"), halflife)
    return pairs.withColumn("heat", r(heat)).where(F.col("heat") >= threshold).select(F.col("country_code_a").alias("source"), F.col("country_code_b").alias("target"), r(F.col("similarity")).alias("similarity"), "heat", F.array_join("topics", ",").alias("topics"))


def hotspots(S: DataFrame, mentions: Column, signal_intensity: Column | None = None) -> DataFrame:
    """Countries by topics: intensity from number, size and confidence of topics; dominant tone, variety of outlets, top five.

    Where signals have an intensity of their own (``signal_intensity``), a country's is the mean of these.
    """
    rows = R.exploded(S.withColumn("m", mentions)).groupBy("country_code", "theme").agg(F.sum("m").alias("count"), F.avg("geo_confidence").alias("confidence"))
    base = rows.groupBy("country_code").agg(F.count("*").alias("topics"), F.avg("count").alias("avg_count"), F.avg("confidence").alias("avg_conf"))
    tones = S.groupBy("country_code", exprs.tone_label(F.col("sentiment")).alias("label")).agg(F.count("*").alias("k")).groupBy("country_code").agg(F.min_by("label", F.struct(-F.col("k"), "label")).alias("dominant"))
    outlets = S.groupBy("country_code").agg((F.countDistinct("source_name") / F.count("*")).alias("diversity"))
    best = top_per(rows, ["country_code"], [F.desc("count"), F.asc("theme")], 5).groupBy("country_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "theme"))), lambda x: x["theme"]), ",").alias("top_topics"))
    intensity = 0.4 * F.least(F.col("topics") / 100.0, F.lit(1.0)) + 0.3 * F.least(F.col("avg_count") / 1000.0, F.lit(1.0)) + 0.3 * F.col("avg_conf")
    joined = reduce(lambda x, y: x.join(y, "country_code"), [tones, outlets, best], base)
    if signal_intensity is not None:
        own = S.groupBy("country_code").agg(F.avg(signal_intensity).alias("own_intensity"))
        joined, intensity = joined.join(own, "country_code", "left"), F.coalesce("own_intensity", intensity)
    return joined.select("country_code", "topics", r(intensity).alias("intensity"), "dominant", r(F.col("diversity")).alias("diversity"), "top_topics")


def active_flows(flows: DataFrame, countries: DataFrame, least: float = 0.5) -> DataFrame:
    """Flows of at least some heat with both countries' names."""
    rows = flows.where(F.col("heat") >= least)
    for x in ("source", "target"):
        rows = rows.join(countries.select(F.col("country_code").alias(x), F.col("name").alias(f"{x}_name")), x, "left")
    return rows.select("source", "source_name", "target", "target_name", "heat")


# Graphs


def temporal_graph(S: DataFrame, theme: str, countries: int = 12, related: int = 5, people: int = 5, sources: int = 8) -> dict[str, DataFrame]:
    """Hourly nodes and links around a theme, with the largest countries, sources, people and themes of each hour.

    Rows of a country beyond an hour's cap make no country, source or person links; related themes come from all rows. The
    signals are read once: every row becomes its edges, which are counted by hour, and the caps are ranks among these counts.
    """
    rows = S.where(F.array_contains("themes", theme)).select(R.hour().alias("hour"), "country_code", "source_name", "sentiment", "persons", "themes")
    edge = lambda kind, item: F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"))
    others = F.slice(F.filter("themes", lambda x: x != theme), 1, related)
    edges = F.concat(F.array(edge("country", F.col("country_code")), edge("source", F.col("source_name"))), F.transform(F.slice(F.coalesce("persons", F.array().cast("array<string>")), 1, people), lambda p: edge("person", p)), F.transform(others, lambda x: edge("theme", x)))
    flat = rows.select("hour", "country_code", "sentiment", F.explode(edges).alias("e"))
    counted = flat.groupBy("hour", "country_code", "e.kind", "e.item").agg(F.count("*").alias("n"), F.count("sentiment").alias("k"), F.sum("sentiment").alias("s"))
    of = lambda kind: F.col("kind") == kind
    # an hour's edges are now one row for each pair of things, so its windows hold few rows
    hour, total = Window.partitionBy("hour"), lambda kind, *keys: F.sum(F.when(of(kind), F.col("n"))).over(Window.partitionBy("hour", *keys))
    sized = counted.withColumn("of_country", total("country", "country_code")).withColumn("of_source", F.when(of("source"), total("source", "kind", "item")))
    ranked = sized.withColumn("country_rank", F.dense_rank().over(hour.orderBy(F.col("country_code").isNull(), F.desc("of_country"), "country_code")))
    ranked = ranked.withColumn("source_rank", F.dense_rank().over(hour.orderBy(F.col("item").isNull() | ~of("source"), F.desc("of_source"), "item")))
    placed = F.col("country_code").isNotNull() & (F.col("country_rank") <= countries) & F.col("item").isNotNull()
    kept = ranked.where((of("theme") & F.col("item").isNotNull()) | (placed & (~of("source") | (F.col("source_rank") <= sources))))
    caps = F.when(of("theme"), related).when(of("country"), countries).when(of("source"), sources).otherwise(2 * people)
    named = kept.withColumn("id", F.concat_ws("-", "kind", "item")).withColumn("size", F.sum("n").over(Window.partitionBy("hour", "id")))
    shown = named.withColumn("rank", F.dense_rank().over(Window.partitionBy("hour", "kind").orderBy(F.desc("size"), "id"))).where(F.col("rank") <= caps)
    centre = F.lit(f"theme-{theme}")
    source = F.when(of("theme"), centre).otherwise(F.col("id"))
    target = F.when(of("theme"), F.col("id")).when(of("country"), centre).otherwise(F.concat(F.lit("country-"), "country_code"))
    label = F.when(of("theme"), "related-theme").when(of("country"), "country-theme").otherwise(F.concat("kind", F.lit("-country")))
    return {
        "nodes": shown.groupBy("hour", "id", F.col("kind").alias("type")).agg(F.sum("n").alias("n"), r(F.try_divide(F.sum("s"), F.sum("k"))).alias("sentiment")),
        "links": shown.groupBy("hour", source.alias("source"), target.alias("target"), label.alias("kind")).agg(F.sum("n").alias("n")),
    }


def entity_graph(S: DataFrame, entities: DataFrame, per_group: int = 8) -> DataFrame:
    """Links of each entity (kind, value) to the things that most often come with it, at most ``per_group`` of each kind.

    Kinds are theme, person, source and country. A row's things stay together while its entities are found by a join, so signals are
    read once and never joined with themselves.
    """
    thing = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    every = F.concat(F.transform("themes", lambda x: thing("theme", x)), F.transform("persons", lambda x: thing("person", x)), F.array(thing("source", F.col("source_name")), thing("country", F.col("country_code"))))
    rows = S.select(F.filter(every, lambda x: x["value"].isNotNull()).alias("things"))
    pins = rows.select("things", F.explode("things").alias("pin")).select("things", F.col("pin.kind").alias("kind"), F.col("pin.value").alias("value"))
    met = pins.join(entities.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select(F.col("kind").alias("kind_a"), F.col("value").alias("a"), F.explode("things").alias("x"))
    near = met.select("kind_a", "a", F.col("x.kind").alias("kind_b"), F.col("x.value").alias("b")).where("not (kind_a = kind_b and a = b)")
    counts = near.groupBy("kind_a", "a", "kind_b", "b").agg(F.count("*").alias("weight"))
    top = top_per(counts, ["kind_a", "a", "kind_b"], [F.desc("weight"), F.asc("b")], per_group).drop("rank")
    x, y = F.concat_ws("-", "kind_a", "a"), F.concat_ws("-", "kind_b", "b")
    return top.groupBy(F.least(x, y).alias("source"), F.greatest(x, y).alias("target")).agg(F.max("weight").alias("weight"))


def geo_pattern(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """How each theme spreads over regions: concentrated, two regions, global, or led by one."""
    rows = counts.join(regions, "country_code", "left")
    totals = rows.groupBy("theme").agg(F.sum("n").alias("total"), F.countDistinct("country_code").alias("countries"))
    per = rows.where("region is not null").groupBy("theme", "region").agg(F.sum("n").alias("k")).join(totals, "theme").withColumn("pct", F.round(100.0 * F.col("k") / F.col("total")))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("k"), "region")))
    at = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    wide = ranked.groupBy("theme").agg(F.max("countries").alias("countries"), F.count("*").alias("n_regions"), at(1, "region").alias("first"), at(1, "pct").alias("p1"), at(2, "region").alias("second"), F.coalesce(at(2, "pct"), F.lit(0.0)).alias("p2"))
    kind = (
        F.when(F.col("countries") < 3, "too_few")
        .when(F.col("p1") >= 65, "concentrated")
        .when((F.col("p2") >= 15) & (F.col("p1") + F.col("p2") >= 70), "two_regions")
        .when(F.col("p2") >= 15, "led_by_two")
        .when((F.col("n_regions") >= 4) & (F.col("p1") < 40), "global")
        .otherwise("strongest")
    )
    return wide.select("theme", "countries", "first", "p1", "second", "p2", kind.alias("pattern"))


def v1_nodes(mentions: DataFrame) -> DataFrame:
    """Countries from the theme rollup: events over the largest, clamped tone, top three themes."""
    base = mentions.groupBy("country_code").agg(F.sum("events").alias("events"), F.avg("avg_tone").alias("tone"))
    best = top_per(mentions.groupBy("country_code", "theme").agg(F.sum("events").alias("k")), ["country_code"], [F.desc("k"), F.asc("theme")], 3).groupBy("country_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "theme"))), lambda x: x["theme"]), ",").alias("themes"))
    rows = base.join(best, "country_code").join(F.broadcast(base.agg(F.max("events").alias("most"))))
    return rows.select("country_code", "events", r(F.col("events") / F.col("most")).alias("intensity"), R.exact(exprs.clamped_tone(F.col("tone")), 4).alias("tone"), "themes")


# Grids


def hex_cell(lat: Column, lon: Column, size: float) -> Column:
    """Axial coordinates (q, r) of a hexagon with corners up, of ``size`` degrees from centre to corner."""
    q0, r0 = (F.lit(3.0**0.5 / 3) * lon - lat / 3.0) / size, (lat * (2.0 / 3)) / size
    q, rr, s = F.round(q0), F.round(r0), F.round(-q0 - r0)
    dq, dr, ds = F.abs(q - q0), F.abs(rr - r0), F.abs(s + q0 + r0)
    return F.struct(
        F.when((dq > dr) & (dq > ds), -rr - s).otherwise(q).cast("int").alias("q"),
        F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -q - s).otherwise(rr).cast("int").alias("r"),
    )


def grid_smooth(points: DataFrame, size: float = 2.0, k: int = 2, normalise: bool = True, decay: float | None = None) -> DataFrame:
    """Points (latitude, longitude, intensity) on a hexagonal grid, each cell spread to its neighbours up to k steps away.

    A cell gives i / (1 + d) to a cell d steps away, or i * decay^d.
    """
    cells = points.groupBy(hex_cell(F.col("latitude"), F.col("longitude"), size).alias("c")).agg(F.sum("intensity").alias("i"))
    span = F.sequence(F.lit(-k), F.lit(k))
    ring = cells.select("c", "i", F.explode(span).alias("dq")).select("c", "i", "dq", F.explode(span).alias("dr"))
    d = (F.abs("dq") + F.abs("dr") + F.abs(F.col("dq") + F.col("dr"))) / 2
    share = F.col("i") / (1 + d) if decay is None else F.col("i") * F.pow(F.lit(decay), d)
    out = ring.where(d <= k).groupBy((F.col("c.q") + F.col("dq")).alias("q"), (F.col("c.r") + F.col("dr")).alias("r")).agg(F.sum(share).alias("intensity"))
    if normalise:
        out = out.join(F.broadcast(out.agg(F.max("intensity").alias("most")))).select("q", "r", F.try_divide("intensity", "most").alias("intensity"))
    return out.withColumn("intensity", r(F.col("intensity")))
