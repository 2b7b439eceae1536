"""Queries: rollups, aggregates, windows, top-k, sets, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import rollups as R
from .fixture import AS_OF
from .registry import query

W = lambda h: exprs.in_window(F.col("ts"), AS_OF, h)
HOUR = lambda df, *cols: df.select(*[F.col(c).cast("string").alias(c) if c in ("hour", "day", "first_seen", "last_seen", "ts") else F.col(c) for c in (cols or df.columns)])  # noqa: E731  times as text

EXPLODED = ", t AS (SELECT * EXCLUDE (themes, theme_), theme_ AS theme FROM (SELECT *, unnest(themes) AS theme_ FROM signals))"


@query("e1_country_hourly", "SELECT country_code, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, round(min(sentiment), 6) AS min_sentiment, round(max(sentiment), 6) AS max_sentiment, count(DISTINCT source_name) AS sources FROM signals GROUP BY ALL")
def e1(t):
    return HOUR(R.country_hourly(t.signals))


@query("e2_country_daily", "SELECT country_code, CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS day, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, count(DISTINCT source_name) AS sources FROM signals GROUP BY ALL")
def e2(t):
    return HOUR(R.country_daily(t.signals))


@query("e3_source_hourly", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, source_name AS dim, count(*) AS signal_count, CAST(round(CAST(avg(sentiment) AS DECIMAL(24, 8)), 2) AS DOUBLE) AS avg_sentiment FROM signals GROUP BY ALL")
def e3(t):
    return HOUR(R.rollup_hourly(t.signals, F.col("source_name")))


@query("e4_theme_hourly", EXPLODED + " SELECT theme, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS signal_count, count(DISTINCT country_code) AS countries, count(DISTINCT source_name) AS sources, round(avg(sentiment), 6) AS avg_sentiment, count(nlp_sentiment) AS nlp_count, round(avg(nlp_sentiment), 6) AS nlp_avg FROM t GROUP BY ALL")
def e4(t):
    return HOUR(R.theme_hourly(t.signals))


@query("e5_theme_country_hourly", EXPLODED + " SELECT theme, country_code, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, count(nlp_sentiment) AS nlp_count, round(avg(nlp_sentiment), 6) AS nlp_avg FROM t GROUP BY ALL")
def e5(t):
    return HOUR(R.theme_country_hourly(t.signals))


@query("e6_theme_daily", EXPLODED + " SELECT theme, CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR) AS day, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, count(DISTINCT country_code) AS countries FROM t GROUP BY ALL")
def e6(t):
    return HOUR(R.theme_daily(t.signals))


MENTIONS = EXPLODED + ", h AS (SELECT theme, country_code, date_trunc('hour', ts) AS hour, count(*) AS events, CAST(sum(signal_id % 7) AS BIGINT) AS mentions, round(avg(sentiment), 6) AS avg_tone FROM t GROUP BY ALL)"


@query("e7_theme_mentions", MENTIONS + " SELECT * REPLACE (CAST(hour AS VARCHAR) AS hour) FROM h")
def e7(t):
    return HOUR(R.theme_mentions(t.signals, F.col("signal_id") % 7))


@query("e8_daily_from_hourly", MENTIONS + " SELECT theme, country_code, CAST(CAST(date_trunc('day', hour) AS TIMESTAMP) AS VARCHAR) AS day, CAST(sum(events) AS BIGINT) AS events, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(round(CAST(avg(avg_tone) AS DECIMAL(24, 10)), 4) AS DOUBLE) AS avg_tone FROM h GROUP BY ALL")
def e8(t):
    return HOUR(R.daily_from_hourly(R.theme_mentions(t.signals, F.col("signal_id") % 7)))


@query("e9_merged_aggregates", "SELECT country_code, count(sentiment) AS n, min(sentiment) AS low, max(sentiment) AS high, round(avg(sentiment), 6) AS mean FROM signals GROUP BY ALL")
def e9(t):
    old, new = t.signals.where(W(720)).where(~W(48)), t.signals.where(W(48))
    return R.merge_aggregates(R.partials(old, ["country_code"]), R.partials(new, ["country_code"]), ["country_code"])


@query("e10_conditional_counts", "SELECT country_code, count(*) FILTER (WHERE is_crisis) AS crises, count(*) FILTER (WHERE severity = 'critical') AS critical, round(avg(sentiment) FILTER (WHERE is_crisis), 6) AS crisis_tone FROM signals GROUP BY ALL")
def e10(t):
    return t.signals.groupBy("country_code").agg(F.count_if("is_crisis").alias("crises"), F.count_if(F.col("severity") == "critical").alias("critical"), R.r(F.avg(F.when(F.col("is_crisis"), F.col("sentiment")))).alias("crisis_tone"))


@query("e11_distinct_counts", "SELECT source_family, count(DISTINCT country_code) AS countries, count(DISTINCT source_url) AS urls FROM signals GROUP BY ALL")
def e11(t):
    return t.signals.groupBy("source_family").agg(F.countDistinct("country_code").alias("countries"), F.countDistinct("source_url").alias("urls"))


@query("e12_weighted_tone", EXPLODED + ", h AS (SELECT theme, date_trunc('hour', ts) AS hour, count(*) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment FROM t GROUP BY ALL) SELECT theme, CAST(sum(signal_count) AS BIGINT) AS signal_count, round(sum(avg_sentiment * signal_count) / sum(signal_count), 6) AS tone FROM h GROUP BY ALL")
def e12(t):
    return R.weighted_tone(R.theme_hourly(t.signals), ["theme"])


@query("e13_having", EXPLODED + " SELECT country_code, theme, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 20")
def e13(t):
    return R.exploded(t.signals).groupBy("country_code", "theme").agg(F.count("*").alias("n")).where("n >= 20")


@query("e14_top_actor", ", c AS (SELECT country_code, actor1, count(*) AS n FROM geo_events GROUP BY ALL) SELECT country_code, actor1 AS actor FROM c QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY n DESC, actor1) = 1")
def e14(t):
    counts = t.geo_events.groupBy("country_code", "actor1").agg(F.count("*").alias("n"))
    return counts.groupBy("country_code").agg(F.min_by("actor1", F.struct(-F.col("n"), "actor1")).alias("actor"))


@query("e15_ordered_arrays", ", c AS (SELECT country_code, source_name, count(*) AS n FROM signals GROUP BY ALL) SELECT country_code, array_to_string(list(source_name ORDER BY n DESC, source_name), ',') AS by_count, array_to_string(list_slice(list_sort(list(DISTINCT source_name)), 1, 5), ',') AS first_five FROM c GROUP BY ALL")
def e15(t):
    per = t.signals.groupBy("country_code", "source_name").agg(F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "source_name"))), lambda x: x["source_name"])
    return per.groupBy("country_code").agg(F.array_join(ordered, ",").alias("by_count"), F.array_join(F.slice(F.array_sort(F.collect_set("source_name")), 1, 5), ",").alias("first_five"))


@query("e16_json_timeline", EXPLODED + ", h AS (SELECT theme, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM t GROUP BY ALL) SELECT theme, '[' || string_agg('{\"day\":\"' || day || '\",\"count\":' || n || '}', ',' ORDER BY day) || ']' AS timeline FROM h GROUP BY ALL")
def e16(t):
    per = R.exploded(t.signals).groupBy("theme", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("count"))
    return per.groupBy("theme").agg(F.to_json(F.array_sort(F.collect_list(F.struct("day", "count")))).alias("timeline"))


@query("e17_deviations", ", d AS (SELECT country_code, date_trunc('day', ts) AS day, count(*) AS n FROM signals GROUP BY ALL) SELECT country_code, round(stddev_samp(n), 6) AS sample_sd, round(stddev_pop(n), 6) AS population_sd FROM d GROUP BY ALL")
def e17(t):
    per = t.signals.groupBy("country_code", R.day().alias("day")).agg(F.count("*").alias("n"))
    return per.groupBy("country_code").agg(R.r(F.stddev_samp("n")).alias("sample_sd"), R.r(F.stddev_pop("n")).alias("population_sd"))


@query("e18_family_entropy", ", c AS (SELECT country_code, source_family, count(*) AS n FROM signals GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY country_code) AS p FROM c) SELECT country_code, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds, round(-sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS evenness FROM p GROUP BY ALL")
def e18(t):
    return R.entropy(t.signals, ["country_code"], "source_family").withColumns({c: R.r(F.col(c)) for c in ("entropy", "evenness")})


@query("e19_theme_divergence", EXPLODED + ", g AS (SELECT theme, count(*) AS gn FROM t GROUP BY ALL), c AS (SELECT country_code, theme, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT country_code, n / sum(n) OVER (PARTITION BY country_code) AS p, gn / (SELECT sum(gn) FROM g) AS q FROM c JOIN g USING (theme)) SELECT country_code, round(sum(p * ln(greatest(p / q, 1e-9))), 6) AS kl FROM p GROUP BY ALL")
def e19(t):
    return R.kl_vs_global(R.exploded(t.signals), "country_code", "theme").withColumn("kl", R.r(F.col("kl")))


@query("e20_geo_grid", EXPLODED + " SELECT round(round(latitude / 0.5) * 0.5, 6) AS lat, round(round(longitude / 0.5) * 0.5, 6) AS lon, count(DISTINCT signal_id) AS signal_count, round(avg(sentiment), 6) AS avg_sentiment, array_to_string(list_sort(list(DISTINCT theme)), ',') AS themes FROM t GROUP BY ALL HAVING count(DISTINCT signal_id) >= 3")
def e20(t):
    return R.geo_grid(t.signals, step=0.5).withColumn("themes", F.array_join("themes", ","))


@query("e21_heat_points", ", p AS (SELECT latitude, longitude, count(*) AS n FROM signals WHERE list_contains(themes, 'K1') GROUP BY ALL) SELECT *, round(n / max(n) OVER (), 6) AS intensity FROM p")
def e21(t):
    return R.heat_points(t.signals.where(exprs.focus("theme", "K1")))


@query("e22_share_of_total", "SELECT source_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM signals GROUP BY ALL")
def e22(t):
    return R.share_of_total(t.signals, "source_name")


@query("e23_seen_span", EXPLODED + " SELECT theme, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen, count(*) AS n FROM t GROUP BY ALL")
def e23(t):
    return HOUR(R.seen_span(R.exploded(t.signals)))


@query("e24_duplicate_clusters", "SELECT md5(source_url) AS url_hash, count(*) AS n, count(DISTINCT source_name) AS outlets, CAST(min(ts) AS VARCHAR) AS first_seen FROM signals GROUP BY ALL HAVING count(*) > 1")
def e24(t):
    return HOUR(R.duplicate_clusters(t.signals))


@query("e25_source_health", ", c AS (SELECT country_code, source_name, count(*) AS n FROM signals GROUP BY ALL), a AS (SELECT country_code, CAST(sum(n) AS BIGINT) AS total, count(*) AS outlets, 100.0 * max(n) / sum(n) AS pct FROM c GROUP BY ALL) SELECT country_code, total, outlets, round(pct, 6) AS concentration, round(least(100, 50.0 * outlets / sqrt(total)), 6) AS diversity, round(greatest(0, 100 - 1.5 * pct), 6) AS quality FROM a")
def e25(t):
    return R.source_health(t.signals, "country_code")


@query("f1_top_countries_per_theme", EXPLODED + ", c AS (SELECT theme, country_code, count(*) AS n FROM t GROUP BY ALL) SELECT theme, country_code, n, CAST(row_number() OVER (PARTITION BY theme ORDER BY n DESC, country_code) AS INTEGER) AS rank FROM c QUALIFY rank <= 3")
def f1(t):
    return R.top_per(R.exploded(t.signals).groupBy("theme", "country_code").agg(F.count("*").alias("n")), ["theme"], [F.desc("n"), F.asc("country_code")], 3)


@query("f2_hourly_sample", ", h AS (SELECT signal_id, ts, date_trunc('hour', ts) AS hour FROM signals QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts DESC, signal_id) <= 8) SELECT signal_id, CAST(hour AS VARCHAR) AS hour FROM h ORDER BY ts, signal_id LIMIT 240")
def f2(t):
    return HOUR(R.hourly_sample(t.signals), "signal_id", "hour")


@query("f3_stratified_sample", "SELECT signal_id FROM (SELECT * FROM signals ORDER BY ts DESC, signal_id LIMIT 75000) QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), country_code, source_family, source_lang, is_crisis, severity, event_type ORDER BY ts DESC, signal_id) <= 3")
def f3(t):
    return R.stratified_sample(t.signals, ["country_code", "source_family", "source_lang", "is_crisis", "severity", "event_type"]).select("signal_id")


@query("f5_hourly_change", EXPLODED + ", h AS (SELECT theme, date_trunc('hour', ts) AS hour, count(*) AS signal_count FROM t GROUP BY ALL), l AS (SELECT *, lag(signal_count) OVER (PARTITION BY theme ORDER BY hour) AS previous FROM h) SELECT theme, CAST(hour AS VARCHAR) AS hour, signal_count, previous, signal_count - previous AS delta, round(100.0 * (signal_count - previous) / previous, 2) AS pct FROM l")
def f5(t):
    return HOUR(R.hourly_change(R.theme_hourly(t.signals), "theme"), "theme", "hour", "signal_count", "previous", "delta", "pct")


@query("f6_stance_drift", ", s AS (SELECT signal_id, ts, country_code, event_type, sentiment AS score, CASE WHEN sentiment > 0.5 THEN 'positive' WHEN sentiment > -0.5 THEN 'neutral' WHEN sentiment > -2 THEN 'negative' ELSE 'hostile' END AS label FROM signals), l AS (SELECT *, lag(label) OVER w AS previous_label, lag(score) OVER w AS previous_score FROM s WINDOW w AS (PARTITION BY country_code, event_type ORDER BY ts, signal_id)) SELECT signal_id, label, previous_label, coalesce(label <> previous_label, false) AS changed, round(abs(score - previous_score), 6) AS drift FROM l")
def f6(t):
    rows = t.signals.select("signal_id", "ts", "country_code", "event_type", F.col("sentiment").alias("score"), exprs.framing_label(F.col("sentiment")).alias("label"))
    return R.stance_drift(rows, ["country_code", "event_type"]).select("signal_id", "label", "previous_label", "changed", "drift")


@query("f7_newest_per_url", "SELECT signal_id, source_url FROM signals QUALIFY row_number() OVER (PARTITION BY substr(source_url, 1, 30) ORDER BY ts DESC, signal_id) = 1")
def f7(t):
    return R.first_per(t.signals, [F.substring("source_url", 1, 30)], [F.desc("ts"), F.asc("signal_id")]).select("signal_id", "source_url")


@query("f8_reranked_pages", ", p AS (SELECT title, CAST(sum(views) AS BIGINT) AS views FROM pageviews WHERE title NOT LIKE 'CLICK%' GROUP BY ALL) SELECT title, views, CAST(row_number() OVER (ORDER BY views DESC, title) AS INTEGER) AS rank FROM p QUALIFY rank <= 25")
def f8(t):
    from ..operators.happenings import reranked

    return reranked(t.pageviews.where(~F.col("title").startswith("CLICK")).groupBy("title").agg(F.sum("views").alias("views")), 25)


@query("f9_normalised_countries", ", c AS (SELECT country_code, count(*) AS n FROM signals GROUP BY ALL) SELECT country_code, n, round(n / max(n) OVER (), 6) AS intensity FROM c")
def f9(t):
    per = t.signals.groupBy("country_code").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(per.agg(F.max("n").alias("top")))).select("country_code", "n", R.r(F.col("n") / F.col("top")).alias("intensity"))


@query("g3_crises_by_severity", "SELECT signal_id, severity, crisis_score FROM signals WHERE is_crisis ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, crisis_score DESC, signal_id LIMIT 100")
def g3(t):
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    return t.signals.where("is_crisis").orderBy(rank, F.desc("crisis_score"), "signal_id").limit(100).select("signal_id", "severity", "crisis_score")


@query("g4_priority_order", "SELECT signal_id, round(CASE WHEN is_crisis THEN 3 ELSE 0 END + abs(sentiment) / 5 + geo_confidence, 6) AS priority FROM signals ORDER BY priority DESC, signal_id LIMIT 200")
def g4(t):
    return t.signals.select("signal_id", R.r(F.when(F.col("is_crisis"), 3.0).otherwise(0.0) + F.abs("sentiment") / 5 + F.col("geo_confidence")).alias("priority")).orderBy(F.desc("priority"), "signal_id").limit(200)


@query("g5_top_themes", EXPLODED + " SELECT theme, count(*) AS n FROM t GROUP BY ALL ORDER BY n DESC, theme LIMIT 10")
def g5(t):
    return R.exploded(t.signals).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(10)


@query("g7_theme_groups", EXPLODED + " SELECT CASE WHEN theme LIKE 'SEG_%' THEN 'segment' WHEN theme LIKE 'K%' THEN 'k' ELSE 'other' END AS grp, count(*) AS total FROM t GROUP BY ALL")
def g7(t):
    rows = R.exploded(t.signals).withColumn("grp", F.when(F.col("theme").startswith("SEG_"), "segment").when(F.col("theme").startswith("K"), "k").otherwise("other"))
    return R.grouped_top(rows.groupBy("grp").agg(F.count("*").alias("signal_count")), "grp")


@query("h3_common_persons", ", p AS (SELECT country_code, unnest(persons) AS person FROM signals) SELECT person FROM p WHERE country_code = 'N01' INTERSECT SELECT person FROM p WHERE country_code = 'N02'")
def h3(t):
    people = t.signals.select("country_code", F.explode("persons").alias("person"))
    return people.where("country_code = 'N01'").select("person").intersect(people.where("country_code = 'N02'").select("person"))


@query("h4_dedup_urls", "SELECT min(signal_id) AS signal_id, source_url FROM signals WHERE source_url IS NOT NULL GROUP BY source_url")
def h4(t):
    return R.dedup_urls(t.signals).select("signal_id", "source_url")


@query("h5_dedup_titles", "SELECT min(signal_id) AS signal_id FROM signals GROUP BY lower(headline)")
def h5(t):
    return R.dedup_titles(t.signals).select("signal_id")


@query("h6_merged_lists", ", a AS (SELECT signal_id, source_url, 0 AS list_no FROM signals WHERE source_family = 'wire' UNION ALL SELECT signal_id, source_url, 1 FROM signals WHERE source_family = 'state'), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY list_no, signal_id) = 1) SELECT signal_id, source_url, list_no FROM f ORDER BY list_no, signal_id, source_url LIMIT 300")
def h6(t):
    part = lambda f: t.signals.where(F.col("source_family") == f).select("signal_id", "source_url")
    return R.merged_lists([part("wire"), part("state")], "source_url", "signal_id", 300)


@query("h8_duplication", "SELECT country_code, round(1 - count(DISTINCT lower(headline)) / count(*), 6) AS duplication FROM signals GROUP BY ALL")
def h8(t):
    return R.duplication_index(t.signals, "country_code").withColumn("duplication", R.r(F.col("duplication")))


@query("j3_zipped_unnest", "SELECT signal_id, unnest(themes) AS theme, unnest(persons) AS person FROM signals")
def j3(t):
    return t.signals.select("signal_id", F.explode(F.arrays_zip("themes", "persons")).alias("z")).select("signal_id", F.col("z.themes").alias("theme"), F.col("z.persons").alias("person"))


@query("j4_array_parts", "SELECT signal_id, themes[1] AS first_theme, len(themes) AS n_themes, array_to_string(list_slice(themes, 1, 2), '+') AS two FROM signals")
def j4(t):
    return t.signals.select("signal_id", F.get("themes", F.lit(0)).alias("first_theme"), F.size("themes").cast("long").alias("n_themes"), F.array_join(F.slice("themes", 1, 2), "+").alias("two"))


@query("j12_top_theme_per_country", EXPLODED + ", c AS (SELECT country_code, theme, count(*) AS n FROM t GROUP BY ALL) SELECT country_code, theme AS top_theme, n FROM c QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY n DESC, theme) = 1")
def j12(t):
    per = R.exploded(t.signals).groupBy("country_code", "theme").agg(F.count("*").alias("n"))
    return per.groupBy("country_code").agg(F.min_by(F.struct("theme", "n"), F.struct(-F.col("n"), "theme")).alias("x")).select("country_code", F.col("x.theme").alias("top_theme"), F.col("x.n").alias("n"))


@query("j14_merged_maps", ", m AS (SELECT country_code, event_type AS label, count(*) AS n FROM signals GROUP BY ALL) SELECT country_code, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM m GROUP BY ALL")
def j14(t):
    maps = t.signals.select("country_code", F.create_map("event_type", F.lit(1).cast("long")).alias("m"))
    per = maps.select("country_code", F.explode("m").alias("label", "n")).groupBy("country_code", "label").agg(F.sum("n").alias("n"))
    return per.groupBy("country_code").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "n"))), ",").alias("counts"))
