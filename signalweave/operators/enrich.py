"""Enrichment: lexicon sentiment, selection of batches, model stages, topics, clusters, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from . import rollups as R
from .rollups import r

def lexicon_frame(spark, lexicon: dict[str, dict[str, float]] = fixed.LEXICON) -> DataFrame:
    return spark.createDataFrame([(lang, w, float(x)) for lang, ws in lexicon.items() for w, x in ws.items()], "lang string, word string, weight double")


def lexicon_sentiment(df: DataFrame, key: str, text: str, lang: str, lexicon: DataFrame, least_tokens: int = 3, languages: list[str] = list(fixed.LEXICON)) -> DataFrame:
    """(key, score, confidence): weights of a text's words summed, clamped to 5; confidence at most 0.5.

    A text in none of ``languages`` goes by its script. Only texts of ``least_tokens`` words with a hit get a row. Words meet the lexicon by a join; each text counts its words first.
    """
    words = df.where(F.size(exprs.tokens(F.col(text))) >= least_tokens).select(key, exprs.language_hint(F.col(text), F.col(lang), languages).alias("lang"), F.explode(exprs.tokens(F.col(text))).alias("word"))
    counted = words.join(lexicon, ["lang", "word"]).groupBy(key).agg(F.sum("weight").alias("s"))
    score = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("s")))
    return counted.select(key, F.round(score, 3).alias("score"), F.round(F.least(F.lit(0.5), 0.5 * F.abs(score) / 5.0), 3).alias("confidence"))


def priority(as_of: str) -> Column:
    """Smaller goes first: age in days, less for other languages, interfaces and social posts, and sure places."""
    age = (F.to_timestamp(F.lit(as_of)).cast("double") - F.col("ts").cast("double")) / 86400.0
    lang = F.col("source_lang").isNotNull() & (F.col("source_lang") != "en")
    return age + F.when(lang, -2.0).otherwise(0.0) + F.when(F.col("source_family").isin("api", "social"), -1.0).otherwise(0.0) + F.when(F.col("geo_confidence") > 0.8, -0.5).otherwise(0.0)


def nlp_batch(S: DataFrame, sample: DataFrame, as_of: str, n: int, hot_hours: float = 24, backlog_days: int = 15, pending: Column | None = None) -> DataFrame:
    """A batch in three lanes: newest by priority (65 %), the stratified sample (25 %), older rows for what is left."""
    pending = F.col("nlp_sentiment").isNull() if pending is None else pending
    rows = S.where(pending & (F.length("headline") > 10)).withColumn("p", priority(as_of))
    hot_n, sample_n = max(1, -(-n * 65 // 100)), max(1, -(-n * 25 // 100))
    hot = rows.where(exprs.in_window(F.col("ts"), as_of, hot_hours)).orderBy("p", "signal_id").limit(hot_n).select("signal_id", F.lit("hot").alias("lane"), F.lit(0).alias("lane_no"), "p")
    picked = rows.join(sample.select("signal_id"), "signal_id", "left_semi").join(hot, "signal_id", "left_anti").orderBy(F.asc("ts"), "signal_id").limit(sample_n).select("signal_id", F.lit("sample").alias("lane"), F.lit(1).alias("lane_no"), "p")
    old = rows.where(exprs.in_window(F.col("ts"), as_of, backlog_days * 24, hot_hours)).join(hot.unionByName(picked), "signal_id", "left_anti").orderBy("p", "signal_id").limit(n).select("signal_id", F.lit("backlog").alias("lane"), F.lit(2).alias("lane_no"), "p")
    return hot.unionByName(picked).unionByName(old).orderBy("lane_no", "p", "signal_id").limit(n).select("signal_id", "lane")


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's scorer over batches of rows; it loads its model once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def framing_or_null(scores: Column, least: float = 0.35) -> Column:
    """The label of the largest probability in a map, if that is ``least`` or more; ties go to the smaller label."""
    best = F.get(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(0))
    return F.when(-best["v"] >= least, best["k"])


def clean_entities(df: DataFrame, key: str = "signal_id", kinds: tuple = ("PERSON", "ORG", "GPE")) -> DataFrame:
    """Entities (key, name, type, lang) of allowed types that are valid, each once in any case, the first spelling by order."""
    good = df.where(F.col("type").isin(*kinds) & exprs.entity_valid(F.col("name"), F.col("lang")))
    return R.first_per(good, [F.col(key), F.lower("name")], [F.asc("name"), F.asc("type")])


def chosen_persons(nlp_persons: Column, persons: Column) -> Column:
    """Names of the model's PERSON entities, else the raw ones; three at most."""
    named = F.transform(F.filter(nlp_persons, lambda p: p["type"] == "PERSON"), lambda p: p["name"])
    return F.slice(F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(persons), 1, 3)


def nlp_progress(S: DataFrame, as_of: str) -> DataFrame:
    pending = F.col("nlp_sentiment").isNull()
    hours = (F.to_timestamp(F.lit(as_of)).cast("double") - F.min(F.when(pending, F.col("ts"))).cast("double")) / 3600.0
    return S.agg(F.count_if(pending).alias("pending"), F.count_if(pending & exprs.in_window(F.col("ts"), as_of, 24)).alias("pending_24h"), F.count("*").alias("total"), R.two(hours).alias("lag_hours"))


def topic_frame(spark, seeds: dict[str, tuple] = fixed.TOPIC_SEEDS) -> DataFrame:
    """(topic, terms, hints) of the seed topics."""
    return spark.createDataFrame([(slug, terms, hints) for slug, (_, _, terms, hints) in seeds.items()], "topic string, terms array<string>, hints array<string>")


def assign_topics(S: DataFrame, topics: DataFrame, least: float = 0.2, longest: int = 3) -> DataFrame:
    """(signal_id, topic, confidence, evidence): share of a topic's terms in the headline, plus 0.5 for a common theme.

    topics: topic, terms (of up to ``longest`` words), hints. Headlines' words and runs of words meet terms, themes meet hints, by joins.
    """
    hint = lambda w: F.concat(F.lit("\x01"), w)  # noqa: E731  # no run of words looks like this
    terms = topics.select(F.explode("terms").alias("word"), "topic", F.size("terms").alias("n"), F.lit(False).alias("hint"))
    hints = topics.select(F.explode(F.transform("hints", hint)).alias("word"), "topic", F.lit(None).cast("int").alias("n"), F.lit(True).alias("hint"))
    none = F.array().cast("array<string>")
    runs = F.coalesce(F.array_distinct(exprs.word_runs(exprs.tokens(F.col("headline")), longest)), none)
    rows = exprs.computed(S.select("signal_id", "headline", "themes"), keys=F.concat(runs, F.transform(F.coalesce("themes", none), hint)))
    # the topics are a fixed dictionary; unless it is broadcast, every word of every row is shuffled and sorted
    met = rows.select("signal_id", F.explode("keys").alias("word")).join(F.broadcast(terms.unionByName(hints)), "word").groupBy("signal_id", "topic")
    found = met.agg(F.count_if(~F.col("hint")).alias("k"), F.max("n").alias("n"), F.bool_or("hint").alias("hint"), F.collect_set("word").alias("w"))
    confidence = F.least(F.lit(1.0), F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)) + F.when(F.col("hint"), 0.5).otherwise(0.0))
    return found.select("signal_id", "topic", r(confidence).alias("confidence"), F.array_join(F.array_sort(F.transform("w", lambda w: F.ltrim(w, F.lit("\x01")))), ",").alias("evidence")).where(F.col("confidence") >= least)


def simple_summary(S: DataFrame, keys: list[str]) -> DataFrame:
    """The first three titles of each key joined, else its themes, else its number of outlets; the first five URLs."""
    ranked = S.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "signal_id")))
    firsts = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") <= n) & F.col(c).isNotNull(), F.struct("rank", c)))), lambda x: x[c])
    out = ranked.where("rank <= 5").groupBy(*keys).agg(firsts("headline", 3).alias("t"), firsts("source_url", 5).alias("u"), F.flatten(F.collect_list(F.col("themes"))).alias("th"))
    outlets = S.groupBy(*keys).agg(F.countDistinct("source_name").alias("outlets"))
    text = F.when(F.size("t") > 0, F.array_join("t", "; ")).when(F.size("th") > 0, F.array_join(F.array_sort(F.array_distinct("th")), ", ")).otherwise(F.concat(F.col("outlets").cast("string"), F.lit(" sources")))
    return out.join(outlets, keys).select(*keys, text.alias("summary"), F.array_join("u", " ").alias("citations"))


def topic_clusters(items: DataFrame, limit: int = 10, features: int = 1 << 12, seed: int = 42) -> DataFrame:
    """Clusters of titles (id, title): TF-IDF and k-means; label: the title of most copies; confidence from its share.

    Titles are made distinct first; with fewer than four there is one cluster a title.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF

    titles = items.select(exprs.clean_title(F.col("title")).alias("title")).where("title is not null").groupBy(F.lower("title").alias("t")).agg(F.min("title").alias("title"), F.count("*").alias("n"))
    k = min(limit, titles.count() // 2, 10)
    if k < 2:
        return titles.select("title", "n").groupBy(F.col("title").alias("label")).agg(F.sum("n").alias("n")).select("label", "n", F.lit(1).cast("long").alias("titles"), F.lit(0.5).alias("confidence"))
    tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=features).transform(titles.withColumn("w", exprs.tokens(F.col("title"))).orderBy("t"))
    x = IDF(inputCol="tf", outputCol="x").fit(tf).transform(tf)
    found = KMeans(featuresCol="x", predictionCol="c", k=k, seed=seed, maxIter=15).fit(x).transform(x).select("c", "title", "n")
    per = found.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("titles"), F.min_by("title", F.struct(-F.col("n"), "title")).alias("label"))
    every = per.agg(F.sum("n").alias("all_n"))
    return per.join(F.broadcast(every)).select("label", "n", "titles", r(F.least(F.lit(0.95), 0.5 + 0.5 * F.col("n") / F.col("all_n"))).alias("confidence"))
