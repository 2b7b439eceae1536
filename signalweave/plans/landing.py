"""Queries: raw lines made from the tables, parsed and normalised again; sinks and slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..operators import matching
from ..sources import normalize as N
from ..sources import parse as P
from ..sources import sinks as K
from .fixture import AS_OF
from .reference import LIST, QUOTED, dealt, dealt_sql
from .registry import query


def gkg_lines(t):
    """Every signal as a landed line of 27 fields; a tenth is cut short, a tenth has a bad date.

    The given table is one small file; landed files are many, so its rows are dealt over the cores first.
    """
    s, i = t.signals.repartition(t.spark.sparkContext.defaultParallelism), F.col("signal_id")
    stamp = F.when(i % 10 == 3, F.lit("not a date")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    fips = F.element_at(F.array(*map(F.lit, ("UK", "GM", "US", "FR"))), (i % 4 + 1).cast("int"))
    place = F.concat_ws("#", F.lit("3"), F.lit("Town, Land"), fips, F.lit(""), F.lit(""), F.col("latitude").cast("string"), F.col("longitude").cast("string"), F.lit("7"), F.lit("12"))
    wrong = F.lit("9#Nowhere#XX#####;1#Short#US")
    themes = F.concat_ws(";", F.concat(F.lit("KILL,"), i.cast("string")), F.transform("themes", lambda x: F.concat(x, F.lit(",5"))))
    fields = {0: F.concat(F.lit("r"), i.cast("string")), 1: stamp, 2: F.lit("1"), 3: F.col("source_name"), 4: F.concat_ws("/", "source_url", F.concat(F.lit("some-long-title-"), i.cast("string"), F.lit(".html"))), 5: F.concat(F.lit("KILL#"), (i % 9).cast("string"), F.lit("##3#Town#US#A#1.5#2.5#8;BAD#x#")), 7: F.array_join("themes", ";"), 8: themes, 10: F.concat_ws(";", wrong, place), 11: F.array_join("persons", ";"), 12: F.concat_ws(";", F.transform("persons", lambda x: F.concat(F.upper(x), F.lit(",9")))), 15: F.concat_ws(",", F.col("sentiment").cast("string"), *map(F.lit, ("1", "2", "3", "4", "5", "60")))}
    whole = F.concat_ws("\t", *[F.coalesce(fields.get(k, F.lit("")), F.lit("")) for k in range(27)])
    return s.select(F.when(i % 10 == 7, F.concat_ws("\t", F.lit("short"), i.cast("string"))).otherwise(whole).alias("value"))


@query("a1_gkg_counts", "SELECT CASE signal_id % 10 WHEN 7 THEN 'too_few_fields' WHEN 3 THEN 'bad_date' ELSE 'good' END AS kind, count(*) AS n FROM signals GROUP BY ALL")
def a1(t):
    return P.parse_counts(*P.read_gkg(gkg_lines(t)))


@query("a1_gkg_nested", "SELECT concat('r', CAST(signal_id AS VARCHAR)) AS record_id, CAST(1 AS INTEGER) AS places, CAST(1 AS INTEGER) AS counts, CAST(signal_id % 9 AS BIGINT) AS killed, sentiment AS tone, CAST(4 AS INTEGER) AS themes FROM signals WHERE signal_id % 10 NOT IN (3, 7)")
def a1n(t):
    good, _ = P.read_gkg(gkg_lines(t))
    return good.select("record_id", F.size("locations").alias("places"), F.size("counts").alias("counts"), F.get("counts", F.lit(0))["number"].alias("killed"), F.col("tone.tone").alias("tone"), F.size("enhanced_themes").alias("themes"))


@query("a2_gkg_to_signals", "SELECT CASE signal_id % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'US' ELSE 'FR' END AS country_code, 'Some Long Title ' || signal_id AS headline, nullif(latitude, 0) AS latitude, sentiment, true AS is_crisis, 'KILL,' || array_to_string(list_filter(themes, lambda x: length(x) > 2), ',') AS themes, array_to_string(persons, ',') AS persons, round(0.2 + 1 / (1 + len(list_filter(themes, lambda x: length(x) > 2))), 6) AS crisis_score FROM signals WHERE signal_id % 10 NOT IN (3, 7)")
def a2(t):
    rows = N.read_and_normalize(gkg_lines(t))
    return rows.select("country_code", "headline", "latitude", "sentiment", "is_crisis", F.array_join("themes", ",").alias("themes"), F.array_join("persons", ",").alias("persons"), F.round("crisis_score", 6).alias("crisis_score"))


@query("a3_events_scan", "SELECT event_id, quad_class, goldstein, CAST(num_mentions AS INTEGER) AS num_mentions, 'GB' AS country_code, CASE WHEN event_id % 6 = 0 THEN NULL ELSE latitude END AS latitude FROM geo_events")
def a3(t):
    f = {0: F.col("event_id").cast("string"), 6: F.col("actor1"), 16: F.col("actor2"), 25: F.lit("1"), 28: F.col("root_code"), 29: F.col("quad_class").cast("string"), 30: F.col("goldstein").cast("string"), 31: F.col("num_mentions").cast("string"), 53: F.lit("UK"), 56: F.when(F.col("event_id") % 6 == 0, "x").otherwise(F.col("latitude").cast("string")), 59: F.date_format("ts", "yyyyMMddHHmmss")}
    lines = t.geo_events.select(F.concat_ws("\t", *[F.coalesce(f.get(k, F.lit("")), F.lit("")) for k in range(61)]).alias("value"))
    return P.read_events(lines).select("event_id", "quad_class", "goldstein", "num_mentions", "country_code", "latitude")


@query("a4_conflict_scan", "SELECT concat('C', CAST(event_id AS VARCHAR)) AS event_id_cnty, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(num_mentions AS INTEGER) END AS fatalities, CASE WHEN event_id % 5 = 0 THEN NULL ELSE latitude END AS latitude FROM geo_events")
def a4(t):
    e = t.geo_events
    text = lambda c: F.col(c).cast("string")
    raw = e.select(F.concat(F.lit("C"), text("event_id")).alias("event_id_cnty"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.when(F.col("event_id") % 3 == 0, "about 5").otherwise(text("num_mentions")).alias("fatalities"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(text("latitude")).alias("latitude"), text("longitude").alias("longitude"), *[F.lit("x").alias(c) for c in ("event_type", "sub_event_type", "actor1", "actor2", "country", "region", "location", "notes", "source")])
    return P.read_conflicts(raw).select("event_id_cnty", "fatalities", "latitude")


@query("a5_trend_items", "SELECT country_code, keyword, CAST(rank AS INTEGER) AS rank, CASE WHEN rank % 2 = 0 THEN CAST(rank AS BIGINT) * 1000 ELSE CAST(rank AS BIGINT) * 1000000 END AS volume FROM trends WHERE rank <= 15")
def a5(t):
    items = t.trends.select("country_code", (F.col("rank") - 1).alias("position"), F.col("keyword").alias("title"), F.concat(F.col("rank").cast("string"), F.when(F.col("rank") % 2 == 0, "K+").otherwise("M+")).alias("traffic"))
    return P.read_trends(items, 15)


@query("a6_pageviews", ", p AS (SELECT region AS project, title, CAST(sum(views) AS BIGINT) AS views FROM pageviews JOIN countries USING (country_code) GROUP BY ALL), r AS (SELECT project, replace(title, '_', ' ') AS title, views, CAST(row_number() OVER (PARTITION BY project ORDER BY views DESC, title) AS INTEGER) AS rank FROM p QUALIFY rank <= 25) SELECT country_code, title, views, rank FROM r JOIN countries ON region = project")
def a6(t):
    lang = t.countries.select(F.col("region").alias("project"), F.lit("en").alias("language"), "country_code")
    per = t.pageviews.join(lang, "country_code").groupBy("project", "title").agg(F.sum("views").alias("views"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("views")).alias("v"), "title"))), lambda x: F.struct(x["title"].alias("article"), (-x["v"]).alias("views")))
    lists = per.groupBy("project").agg(ordered.alias("a")).select(F.lit("2024-01-30").alias("day"), F.array(F.struct("project", F.concat(F.array(F.struct(F.lit("Main_Page").alias("article"), F.lit(9).cast("long").alias("views"))), "a").alias("articles"))).alias("items"))
    return P.read_pageviews(lists, lang).select("country_code", "title", "views", "rank")


EDITIONS = f", ed AS (SELECT * FROM (VALUES {', '.join(f'({QUOTED(c)}, {QUOTED(l)})' for c, l in fixed.COUNTRY_EDITION.items())}) e(cc, lang)), lg AS (SELECT list(DISTINCT lang ORDER BY lang) AS ls FROM ed)"


@query("a6_editions_of_countries", EDITIONS + ", p AS (SELECT ls[CAST(right(title, 1) AS INTEGER) % len(ls) + 1] AS lang, title, CAST(sum(views) AS BIGINT) AS views FROM pageviews, lg GROUP BY ALL), r AS (SELECT lang, replace(title, '_', ' ') AS title, views, CAST(row_number() OVER (PARTITION BY lang ORDER BY views DESC, title) AS INTEGER) AS rank FROM p QUALIFY rank <= 25) SELECT cc AS country_code, lang AS language, title, views, rank FROM r JOIN ed USING (lang)")
def a6e(t):
    """Lists by language edition to all countries of the fixed table; a list of an edition without countries goes."""
    languages = sorted(set(fixed.COUNTRY_EDITION.values()))
    lang = F.element_at(F.array(*map(F.lit, languages)), (F.substring("title", -1, 1).cast("int") % len(languages) + 1).cast("int"))
    per = t.pageviews.groupBy(F.concat(lang, F.lit(".wikipedia")).alias("project"), "title").agg(F.sum("views").alias("views"))
    per = per.unionByName(per.withColumn("project", F.lit("xx.wikipedia")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("views")).alias("v"), "title"))), lambda x: F.struct(x["title"].alias("article"), (-x["v"]).alias("views")))
    lists = per.groupBy("project").agg(ordered.alias("a")).select(F.lit("2024-01-30").alias("day"), F.array(F.struct("project", F.concat(F.array(F.struct(F.lit("Main_Page").alias("article"), F.lit(9).cast("long").alias("views"))), "a").alias("articles"))).alias("items"))
    return P.read_pageviews(lists).select("country_code", "language", "title", "views", "rank")


#: Texts with a word of each row of the table, with several, with none, and with what only looks like one.
NEWS = [f"Report from {ws[i % len(ws)]} on prices" for i, (_, words) in enumerate(fixed.COUNTRY_WORDS) for ws in [words.split(", ")]]
NEWS += ["", "no place at all", "Romanian ports, Omani oil", "talks in Paris about Kyiv", "NIGERIA and Niger", "Iranians abroad", "a Somali-Kenyan border post", "aden_port", "in LIMA.", "Gulf of Aden, then Gulf of Oman", "Bogotá’s mayor", "São Paulo", "Perugia and Limassol"]
#: (text, code) of those with a country: words between blanks, once all that is no letter, digit or underscore is one.
SPACED = "' ' || regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' '".format
NEWS_CODES = f", kw AS (SELECT *, {SPACED('word')} AS spaced FROM (VALUES {', '.join(f'({i}, {QUOTED(code)}, {QUOTED(word)})' for i, (code, word) in enumerate((code, w) for code, words in fixed.COUNTRY_WORDS for w in words.split(', ')))}) k(no, code, word)), nc AS (SELECT txt, arg_min(code, no) AS code FROM (SELECT txt, {SPACED('txt')} AS spaced FROM (SELECT unnest({LIST(NEWS)}) AS txt)) n JOIN kw ON contains(n.spaced, kw.spaced) GROUP BY ALL)"
WITH_NEWS = dealt_sql(NEWS, "txt") + NEWS_CODES


def news_items(t, **more):
    rows = dealt(t, NEWS, "txt").select("signal_id", "headline", F.col("source_url").alias("link"), F.concat(F.lit("<p>"), "txt", F.lit("</p>")).alias("description"), "ts", "txt")
    return rows.withColumns({"title": F.col("headline")} | more)


@query("c18_country_words", WITH_NEWS + " SELECT signal_id, code FROM x LEFT JOIN nc USING (txt)")
def c18(t):
    """Every signal's text through the whole table of country words."""
    return dealt(t, NEWS, "txt").select("signal_id", matching.first_listed(F.col("txt"), fixed.COUNTRY_WORDS).alias("code"))


@query("c18_country_mentions", WITH_NEWS + ", m AS (SELECT DISTINCT txt, code FROM (SELECT unnest(" + LIST(NEWS) + ") AS txt) JOIN kw ON contains(lower(txt), lower(word))) SELECT code, count(*) AS n FROM x JOIN m USING (txt) GROUP BY ALL")
def c18m(t):
    """How many texts have a word of each country, also within other words."""
    words, codes = matching.listed(fixed.COUNTRY_WORDS)
    names = t.spark.createDataFrame(list(zip(words, codes)), "word string, code string")
    return matching.matches(dealt(t, NEWS, "txt").select("signal_id", "txt"), "txt", words).join(F.broadcast(names), "word").select("signal_id", "code").distinct().groupBy("code").agg(F.count("*").alias("n"))


@query("a7_feed_articles", WITH_NEWS + " SELECT headline, 'src' || CAST(split_part(split_part(source_name, 'src', 2), '.', 1) AS VARCHAR) || '.example.com' AS source_name, coalesce(code, 'ZZ') AS country_code, 'reporting' AS signal_class FROM x LEFT JOIN nc USING (txt) WHERE ts > {AS_OF} - INTERVAL 240 HOURS AND source_name <> 'src5.example.com'")
def a7(t):
    since = F.to_timestamp(F.lit(AS_OF)) - F.expr("INTERVAL 240 HOURS")
    items = news_items(t, title=F.concat(F.lit("<b>"), "headline", F.lit("</b>")))
    return N.normalize_articles(items, N.Feed(country="ZZ"), since, ["src5.example.com"]).select("headline", "source_name", "country_code", "signal_class")


@query("a10_social_posts", WITH_NEWS + " SELECT headline, coalesce(code, 'XX') AS country_code, 'social_commentary' AS signal_class, geo_confidence * 0 + 0.5 AS geo_confidence FROM x LEFT JOIN nc USING (txt) WHERE signal_id % 8 <> 0")
def a10(t):
    posts = news_items(t, title=F.when(F.col("signal_id") % 8 == 0, "[removed]").otherwise(F.col("headline")), external_url=F.col("link"), link=F.lit("https://social.example.org/p"))
    return N.normalize_articles(posts, N.FEEDS["social"]).select("headline", "country_code", "signal_class", "geo_confidence")


@query("a9_provider_articles", WITH_NEWS + " SELECT headline, CASE WHEN signal_id % 3 = 0 THEN 'FR' ELSE coalesce(code, 'XX') END AS country_code, geo_confidence * 0 + 0.7 AS geo_confidence, 'api' AS source_family FROM x LEFT JOIN nc USING (txt)")
def a9(t):
    """A provider's own country only counts with two letters; else words tell."""
    items = news_items(t, provider_country=F.when(F.col("signal_id") % 3 == 0, "fr").otherwise("france"))
    return N.normalize_articles(items, N.FEEDS["news_by_provider"]).select("headline", "country_code", "geo_confidence", "source_family")


@query("a8_humanitarian", WITH_NEWS + ", y AS (SELECT *, CASE signal_id % 4 WHEN 0 THEN 'HT' WHEN 1 THEN 'TZ' ELSE code END AS cc FROM x LEFT JOIN nc USING (txt)) SELECT headline, cc AS country_code, true AS is_crisis, 0.5::DOUBLE AS crisis_score, 'humanitarian' AS signal_class FROM y WHERE cc IS NOT NULL")
def a8(t):
    """A tag with the country goes before words; an unknown one leaves it to the words; rows without a country go."""
    tag = F.when(F.col("signal_id") % 4 == 0, "Country: Haiti<br>").when(F.col("signal_id") % 4 == 1, "<i>x</i> Country:  dodoma, ").when(F.col("signal_id") % 4 == 2, "Country: Nowhere. ").otherwise("")
    return N.normalize_articles(news_items(t, description=F.concat(tag, "txt")), N.FEEDS["humanitarian"]).select("headline", "country_code", "is_crisis", "crisis_score", "signal_class")


@query("a11_combined_feeds", "SELECT source_family, count(*) AS n FROM (SELECT 'social' AS source_family FROM signals UNION ALL SELECT 'api' FROM signals) GROUP BY ALL")
def a11(t):
    items = t.signals.select(F.col("headline").alias("title"), F.col("source_url").alias("link"), "ts")
    both = N.combined([N.normalize_articles(items, N.FEEDS[k]) for k in ("social", "news_by_words")])
    return both.groupBy("source_family").agg(F.count("*").alias("n"))


@query("a13_missing_slots", "SELECT CAST(slot AS VARCHAR) AS slot FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 15 MINUTES)) AS slot) WHERE slot NOT IN (SELECT time_bucket(INTERVAL 15 MINUTES, ts) FROM signals)")
def a13(t):
    return K.missing_slots(t.signals, "2024-01-10 00:00:00", "2024-01-12 00:00:00").select(F.col("slot").cast("string").alias("slot"))


@query("a14_page_meta", "SELECT page_id, substr(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 1, 500) AS title FROM pages")
def a14(t):
    return P.page_meta(t.raw("pages")).select("page_id", "title")


@query("a14_page_meta_tags", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Og ' || page_id ELSE substr(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 1, 500) END AS title, CASE page_id % 3 WHEN 0 THEN 'About ' || page_id WHEN 1 THEN 'Also ' || page_id END AS description FROM pages")
def a14m(t):
    """Pages with a description in either order of its attributes, or only an og: one, or none; some without a title element."""
    i, text = F.col("page_id"), F.col("page_id").cast("string")
    about = F.when(i % 3 == 0, F.concat(F.lit("<meta name='description' lang=en content='About "), text, F.lit("'>"))).when(i % 3 == 1, F.concat(F.lit('<META CONTENT="Also '), text, F.lit('" property="og:description">'))).otherwise("")
    title = F.when(i % 4 == 0, F.concat(F.lit('<meta property="og:title" content="Og '), text, F.lit('">'))).otherwise("")
    html = F.when(i % 4 == 0, F.regexp_replace("html", "(?is)<title.*?</title>", "")).otherwise(F.col("html"))
    return P.page_meta(t.raw("pages").withColumn("html", F.concat(title, about, html))).select("page_id", "title", "description")


@query("a11_combined_rows", "SELECT headline, source_url, 'social' AS source_family, 'XX' AS country_code, geo_confidence * 0 + 0.5 AS geo_confidence, 'social_commentary' AS signal_class FROM signals UNION ALL SELECT headline, source_url, 'api', 'XX', geo_confidence * 0 + 0.65, 'reporting' FROM signals UNION ALL SELECT headline, source_url, 'rss', NULL, geo_confidence * 0 + 0.6, 'reporting' FROM signals")
def a11r(t):
    """The same items as three feeds, as one frame of whole rows."""
    items = t.signals.select(F.col("headline").alias("title"), F.col("source_url").alias("link"), "ts")
    every = N.combined([N.normalize_articles(items, N.FEEDS[k]) for k in ("social", "news_by_words", "rss")])
    return every.select("headline", "source_url", "source_family", "country_code", "geo_confidence", "signal_class")


@query("a15_new_rows", "SELECT min(signal_id) AS signal_id, source_url FROM signals WHERE event_type = 'click' AND source_url NOT IN (SELECT source_url FROM signals WHERE event_type = 'view' OR event_type = 'purchase') GROUP BY source_url")
def a15(t):
    new, old = t.signals.where("event_type = 'click'"), t.signals.where("event_type in ('view', 'purchase')")
    return K.new_rows(new.select("signal_id", "source_url"), old.select("source_url"), "source_url")


@query("a16_merged_rows", ", o AS (SELECT country_code, max(sentiment) AS top, min(headline) AS head, count(*) AS n FROM signals WHERE event_type = 'click' GROUP BY ALL), w AS (SELECT country_code, max(sentiment) AS top, max(headline) AS head, count(*) AS n FROM signals WHERE event_type <> 'click' GROUP BY ALL) SELECT country_code, CASE WHEN o.top IS NULL THEN w.top WHEN w.top IS NULL THEN o.top ELSE greatest(o.top, w.top) END AS top, coalesce(o.head, w.head) AS head, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (country_code)")
def a16(t):
    part = lambda c, f: t.signals.where(c).groupBy("country_code").agg(F.max("sentiment").alias("top"), f("headline").alias("head"), F.count("*").alias("n"))
    return K.merge_rows(part("event_type = 'click'", F.min), part("event_type <> 'click'", F.max), ["country_code"], {"top": "greatest", "head": "old", "n": "new"})


@query("a18_bridges", "SELECT signal_id, array_to_string(list_sort(list_distinct(themes)), ',') AS themes, array_to_string(list_sort(list_distinct(persons)), ',') AS persons FROM signals WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def a18(t):
    back = K.from_bridges(K.to_bridges(t.signals), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return back.select("signal_id", F.array_join("themes", ",").alias("themes"), F.array_join("persons", ",").alias("persons"))


@query("a19_new_members", "SELECT DISTINCT country_code FROM signals WHERE country_code NOT IN (SELECT country_code FROM countries WHERE region <> 'R1')")
def a19(t):
    return K.new_members(t.signals, t.countries.where("region <> 'R1'"))


@query("c17_iso_and_domains", "SELECT source_url, source_name AS domain, 'independent' AS family FROM signals GROUP BY ALL")
def c1(t):
    return t.signals.select("source_url").distinct().select("source_url", exprs.domain(F.col("source_url")).alias("domain"), exprs.source_family(F.col("source_url")).alias("family"))


@query("c1_page_domains", "SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1), '^www\\.', '') AS domain FROM pages")
def c1p(t):
    return t.raw("pages").select("page_id", exprs.domain(F.col("url")).alias("domain"))


@query("b12_records_in_country", "SELECT concat('r', CAST(signal_id AS VARCHAR)) AS record_id FROM signals WHERE signal_id % 10 NOT IN (3, 7) AND signal_id % 4 = 1")
def b12(t):
    return P.in_country(P.read_gkg(gkg_lines(t))[0], "GM").select("record_id")


@query("b13_records_by_text", "SELECT concat('r', CAST(signal_id AS VARCHAR)) AS record_id FROM signals WHERE signal_id % 10 NOT IN (3, 7) AND (contains(source_name, 'src12') OR len(list_filter(persons, lambda p: contains(p, 'src12'))) > 0 OR len(list_filter(themes, lambda x: contains(lower(x), 'src12'))) > 0)")
def b13(t):
    return P.text_filter(P.read_gkg(gkg_lines(t))[0], "SRC12").select("record_id")


@query("c20_primary_locations", "SELECT concat('r', CAST(signal_id AS VARCHAR)) AS record_id, CASE signal_id % 4 WHEN 0 THEN 'UK' WHEN 1 THEN 'GM' WHEN 2 THEN 'US' ELSE 'FR' END AS country FROM signals WHERE signal_id % 10 NOT IN (3, 7)")
def c20(t):
    return P.read_gkg(gkg_lines(t))[0].select("record_id", P.primary_location(F.col("locations"), "US")["country_code"].alias("country"))


@query("a12_slot_paths", "SELECT strftime(slot, '%Y%m%d%H%M%S') || '.gkg.csv' AS path, count(signal_id) > 0 AS landed FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11', INTERVAL 15 MINUTES)) AS slot) LEFT JOIN signals ON time_bucket(INTERVAL 15 MINUTES, ts) = slot GROUP BY ALL")
def a12(t):
    slots = K.slot_paths(t.spark, "yyyyMMddHHmmss'.gkg.csv'", "2024-01-10 00:00:00", "2024-01-11 00:00:00")
    seen = t.signals.select(F.window("ts", "15 minutes")["start"].alias("slot")).distinct().withColumn("landed", F.lit(True))
    return slots.join(seen, "slot", "left").select("path", F.coalesce("landed", F.lit(False)).alias("landed"))
