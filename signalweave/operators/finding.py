"""Search: variants of queries, items by text, fuzzy suggestions, matching against dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, exprs, fixed
from . import fuzzy
from .rollups import containing, r, top_per


def query_variants(queries: DataFrame, most: int = 24) -> DataFrame:
    """(query, variant, rank) from the most precise to the broadest: itself, aliases, joined, singular, other orders.

    The orders of two or three words come from their places; a leading ``ortho`` of a long single word may go.
    """
    empty = F.array().cast("array<string>")
    q = exprs.search_text(F.col("query"))
    words = F.split(q, " ")
    n = F.size(words)
    alias = lambda x: F.coalesce(F.try_element_at(F.create_map(*[v for k, xs in dims.SEARCH_ALIASES.items() for v in (F.lit(k), F.array(*map(F.lit, xs)))]), x), empty)
    one = F.transform(words, lambda w: exprs.singular(w))
    at = lambda *ix: F.array_join(F.array(*[F.get(words, F.lit(i)) for i in ix]), " ")
    orders = F.when(n == 2, F.array(at(0, 1), at(1, 0))).when(n == 3, F.array(at(0, 1, 2), at(0, 2, 1), at(1, 0, 2), at(1, 2, 0), at(2, 0, 1), at(2, 1, 0))).otherwise(empty)
    several = F.concat(F.array(F.array_join(words, "")), F.array(F.array_join(one, " ")), orders)
    single = F.concat(F.array(F.get(one, F.lit(0))), F.when(F.get(one, F.lit(0)) != q, alias(F.get(one, F.lit(0)))).otherwise(empty), F.when(q.startswith("ortho") & (F.length(q) > 8), F.array(F.expr("substring(q, 6)"))).otherwise(empty))
    every = F.concat(F.array(q), alias(q), F.when(n > 1, several).otherwise(single))
    rows = queries.withColumn("q", q).select("query", F.posexplode(F.slice(F.array_distinct(F.filter(every, lambda v: F.coalesce(v, F.lit("")) != "")), 1, most)).alias("rank", "variant"))
    return rows.select("query", "variant", (F.col("rank") + 1).alias("rank"))


def search_items(S: DataFrame, words: list[str], array: str, least: int = 2, limit: int = 10, excluded: tuple = ("TAX_", "WORLDLANGUAGES_")) -> DataFrame:
    """Themes or persons of rows in which any element contains any of the words: totals and top three countries."""
    rows = S.where(exprs.like_any(F.array_join(array, " "), words)).select("country_code", F.explode(array).alias("item"))
    for x in excluded:
        rows = rows.where(~F.col("item").startswith(x))
    counts = rows.groupBy("item", "country_code").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = counts.groupBy("item").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "item").limit(limit)
    top = top_per(counts.join(F.broadcast(totals), "item"), ["item"], [F.desc("n"), F.asc("country_code")], 3)
    return top.groupBy("item", "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "country_code", "n").alias("x")))), lambda x: x["x"]), ",").alias("countries"))


def search_countries(countries: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """By code, whole name, start of the name, or part of it, in this order."""
    q, name = text.lower(), F.lower("name")
    rank = F.when(F.lower("country_code") == q, 1).when(name == q, 2).when(name.startswith(q), 3).when(name.contains(q), 4)
    return countries.withColumn("rank", rank).where("rank is not null").orderBy("rank", "name").limit(limit).select("country_code", "name", "rank")


def search_signals(S: DataFrame, words: list[str], limit: int = 50) -> DataFrame:
    return S.where(exprs.like_any(F.col("headline"), words) | exprs.like_any(F.col("source_name"), words)).orderBy(F.desc("ts"), "signal_id").limit(limit)


def search_pages(pageviews: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    return pageviews.where(exprs.like_any(F.col("title"), words)).groupBy("title").agg(F.sum("views").alias("views")).orderBy(F.desc("views"), "title").limit(limit)


def offered(query: Column, value: Column, score: Column) -> Column:
    """Whether a fuzzy hit is strong enough to show for a query."""
    q, v = exprs.search_text(query), exprs.search_text(value)
    least = F.when(F.length(q) <= 3, 0.68).when((F.length(q) >= 8) & q.contains(" "), 0.25).otherwise(0.45)
    return (q != "") & (v != "") & (q != v) & (score >= least)


def fuzzy_candidates(queries: DataFrame, values: DataFrame, least: float = 0.25) -> DataFrame:
    """(query, value, kind, n, score) with a trigram similarity of ``least`` or more: distinct texts are compared, by the prefixes of their grams."""
    return fuzzy.gram_pairs(queries, values, least).join(values.select("value", "kind", "n"), "value").select("query", "value", "kind", "n", "score")


def fuzzy_suggest(queries: DataFrame, S: DataFrame, countries: DataFrame, pageviews: DataFrame, limit: int = 5) -> DataFrame:
    """Suggestions for queries from persons, countries and pages; strong countries, else strong pages, go before all others."""
    persons = S.select(F.explode("persons").alias("value")).where(F.length("value") >= 3).groupBy("value").agg(F.count("*").alias("n")).withColumn("kind", F.lit("person"))
    places = countries.select(F.col("name").alias("value"), F.lit(0).cast("long").alias("n"), F.lit("country").alias("kind"))
    pages = pageviews.groupBy(F.col("title").alias("value")).agg(F.sum("views").alias("n")).withColumn("kind", F.lit("page"))
    hits = fuzzy_candidates(queries, persons.unionByName(places).unionByName(pages))
    # computed on the hits; as plain filters the texts' conditions would go to every row that has a value
    hits = exprs.computed(hits, offered=offered(F.col("query"), F.col("value"), F.col("score")))
    hits = hits.where(F.col("offered") & ~((F.col("kind") == "person") & (F.col("n") < 10) & (F.col("score") < 0.5)))
    top = top_per(hits, ["query"], [F.desc("score"), F.desc("n"), F.asc("kind"), F.asc("value")], limit)
    strength = F.when((F.col("kind") == "country") & (F.col("score") >= 0.5), 2).when((F.col("kind") == "page") & (F.col("score") >= 0.55), 1).otherwise(0)
    best = top.withColumn("s", strength)
    most = best.groupBy("query").agg(F.max("s").alias("most"))
    return best.join(most, "query").where("most = 0 or s = most").select("query", "value", "kind", "n", F.round("score", 3).alias("score"))


def fuzzy_dictionary(queries: DataFrame, entries: DataFrame, least: float = 0.6) -> DataFrame:
    """(query, entry, score): the mean over a query's words of the best match among an entry's words.

    entries: entry, text. Equal to or part of a word (or the other way round) counts 1; under three letters only equal words
    count; else the ratio. A mean of ``least`` needs one word that matches that well, so only entries with such a pair of words are scored
    with all their words. With ``least`` 0 every entry that shares a letter is scored.
    """
    q = exprs.computed(queries.select("query").distinct(), ws=exprs.search_words(F.col("query"))).select("query", F.posexplode("ws").alias("at", "qw"))
    e = exprs.computed(entries.select("entry", "text"), ws=exprs.search_words(F.col("text"))).select("entry", F.explode("ws").alias("ew")).distinct()
    qs, es = q.select("qw").distinct(), e.select("ew").distinct()
    long = qs.where(F.length("qw") > 2)
    inside = containing(es, "ew", long, "qw").select("qw", "ew").union(containing(long, "qw", es, "ew").select("qw", "ew"))
    sure = inside.union(qs.where(F.length("qw") <= 2).join(es, F.col("qw") == F.col("ew"))).distinct().withColumn("s", F.lit(1.0))
    close = fuzzy.close_pairs(long, es, max(least - 1e-6, 0.0))
    known = close.unionByName(sure).groupBy("qw", "ew").agg(F.max("s").alias("s"))
    met = q.join(known, "qw").join(e, "ew")
    if least > 0:
        rows = met.select("query", "entry").distinct().join(q, "query").join(e, "entry")
        rest = rows.where(F.length("qw") > 2).select("qw", "ew").distinct().join(known, ["qw", "ew"], "left_anti")
        met = rows.join(known.unionByName(fuzzy.scored_pairs(rest)), ["qw", "ew"])
    best = met.groupBy("query", "entry", "at").agg(F.max("s").alias("s"))
    n = q.groupBy("query").agg(F.count("*").alias("n"))
    return best.groupBy("query", "entry").agg(F.sum("s").alias("t")).join(n, "query").select("query", "entry", r(F.col("t") / F.col("n")).alias("score")).where(F.col("score") >= least)


def concept_frame(spark, concepts: dict[str, dict] = fixed.CONCEPTS) -> DataFrame:
    return spark.createDataFrame([(k, c["label"], c["description"], c["themes"], c["aliases"], c["related_concepts"]) for k, c in concepts.items()], "slug string, label string, description string, themes array<string>, aliases array<string>, related array<string>")


def fuzzy_concepts(queries: DataFrame, concepts: DataFrame, least: float = 0.7) -> DataFrame:
    """Concepts (slug, label, description, themes, aliases) by the best of: label, slug and aliases, 0.7 description, 0.5 themes.

    A query that is the slug counts 10, one that is an alias 2, one that has an alias within 1.5 at least.
    """
    q = queries.select("query").distinct().withColumn("q", F.trim(F.regexp_replace(exprs.unmarked(F.col("query")), r"\s+", " "))).where(F.size(exprs.search_words(F.col("query"))) > 0)
    slugs = concepts.select("slug", F.explode(F.array("slug", F.translate("slug", "-", " "))).alias("q"))
    exact = q.join(slugs, "q").select("query", "slug", F.lit(10.0).alias("score"))
    aliases = concepts.select("slug", F.explode("aliases").alias("alias")).withColumn("alias", F.trim(F.regexp_replace(exprs.unmarked(F.col("alias")), r"\s+", " ")))
    phrases = containing(q, "q", aliases, "alias").select("query", "slug", F.when(F.col("q") == F.col("alias"), 2.0).otherwise(1.5).alias("score"))
    parts = [(F.concat_ws(" ", "label", F.translate("slug", "-", " "), F.array_join("aliases", " ")), 1.0), (F.col("description"), 0.7), (F.translate(F.array_join("themes", " "), "_", " "), 0.5)]
    found = exact.unionByName(phrases)
    for text, weight in parts:
        if least > weight:  # no score is above 1
            continue
        x = fuzzy_dictionary(queries, concepts.select(F.col("slug").alias("entry"), text.alias("text")), max(least / weight - 1e-5, 0.0))
        found = found.unionByName(x.select("query", F.col("entry").alias("slug"), (F.col("score") * weight).alias("score")))
    return found.groupBy("query", "slug").agg(r(F.max("score")).alias("score")).where(F.col("score") >= least)


def closest_concepts(queries: DataFrame, concepts: DataFrame, limit: int = 3) -> DataFrame:
    """The concepts whose label and slug are nearest to a query, however far: what to suggest where nothing is found."""
    near = fuzzy_dictionary(queries, concepts.select(F.col("slug").alias("entry"), F.concat_ws(" ", "label", F.translate("slug", "-", " ")).alias("text")), 0.0).where("score > 0")
    return top_per(near, ["query"], [F.desc("score"), F.asc("entry")], limit).select("query", F.col("entry").alias("slug"), "score", "rank")


def search_regions(queries: DataFrame, regions: dict[str, dict] = fixed.SEARCH_REGIONS, least: float = 0.5) -> DataFrame:
    """(query, region): the first region of that name or alias, else the one whose alias has the largest share of the query's words."""
    rows = [(i, j, slug, name, j <= 1) for i, (slug, x) in enumerate(regions.items()) for j, name in enumerate([slug, slug.replace("-", " "), *x["aliases"]])]
    names = queries.sparkSession.createDataFrame(rows, "region_no int, name_no int, region string, name string, is_slug boolean").withColumn("name", F.trim(F.regexp_replace(exprs.unmarked(F.col("name")), r"\s+", " ")))
    q = queries.select("query").distinct().withColumn("name", F.trim(F.regexp_replace(exprs.unmarked(F.col("query")), r"\s+", " ")))
    same = q.join(names, "name").select("query", "region", "region_no", "name_no", F.lit(2.0).alias("share"))
    words = q.select("query", F.array_distinct(exprs.search_words(F.col("query"))).alias("ws")).select("query", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    theirs = names.where("not is_slug").select("region", "region_no", "name_no", F.explode(F.array_distinct(exprs.search_words(F.col("name")))).alias("w"))
    shared = words.join(theirs, "w").groupBy("query", "n", "region", "region_no", "name_no").agg(F.count("*").alias("k")).withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= least)
    every = same.unionByName(shared.select("query", "region", "region_no", "name_no", "share"))
    return top_per(every, ["query"], [F.desc("share"), F.asc("region_no"), F.asc("name_no")], 1).select("query", "region")


def unified_search(S: DataFrame, countries: DataFrame, pageviews: DataFrame, text: str) -> DataFrame:
    """Everything that one text finds, as one list (part, item, total, rank): themes, persons, countries, signals, pages, concepts, a
    country or region that it names, and suggestions where there are any."""
    words = [w for w in text.lower().split() if w]
    one = S.sparkSession.createDataFrame([(text,)], "query string")
    concepts = concept_frame(S.sparkSession)
    hits = fuzzy_concepts(one, concepts).select(F.col("slug").alias("item"), F.col("score").alias("total"))
    parts = {
        "theme": search_items(S, words, "themes").select("item", "total"),
        "person": search_items(S, words, "persons", limit=8, excluded=()).select("item", "total"),
        "country": search_countries(countries, text).select(F.col("country_code").alias("item"), (-F.col("rank")).alias("total")),
        "signal": search_signals(S, words).select(F.col("signal_id").cast("string").alias("item"), F.col("ts").cast("long").alias("total")),
        "page": search_pages(pageviews, words).select(F.col("title").alias("item"), F.col("views").alias("total")),
        "concept": hits,
        "named_country": one.select(exprs.country_code(F.col("query")).alias("item"), F.lit(1).alias("total")).where("item is not null"),
        "region": search_regions(one).select(F.col("region").alias("item"), F.lit(1).alias("total")),
        "suggestion": fuzzy_suggest(one, S, countries, pageviews).select(F.col("value").alias("item"), F.col("score").alias("total")),
    }
    rows = [x.select(F.lit(part).alias("part"), "item", F.col("total").cast("double").alias("total")) for part, x in parts.items()]
    every = rows[0]
    for x in rows[1:]:
        every = every.unionByName(x)
    # at most a few dozen rows a part; a filter on the part leaves the others out of the plan
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("total"), "item")))


def merged_hits(first: DataFrame, second: DataFrame, key: str = "item") -> DataFrame:
    """Two lists of hits, an item of the first hides its double in the second."""
    rows = first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)))
    return top_per(rows, [key], [F.asc("source_rank")], 1, "__r").drop("__r")
