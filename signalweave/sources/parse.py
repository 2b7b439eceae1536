"""Raw files to typed rows. Bad rows go to a frame of rejects or give nulls; nothing raises on bad data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, fixed

GKG_COLUMNS = 27
EVENT_COLUMNS = 61


def _num(x: Column, kind: str) -> Column:
    """A number or date from text, null if it is none."""
    return F.trim(x).try_cast(kind)


def split_list(text: Column, sep: str = ";") -> Column:
    """Parts without blanks around them, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def named_offsets(text: Column) -> Column:
    """``NAME,offset`` pairs, split at the last comma; a bad or missing offset is 0."""

    def one(x: Column) -> Column:
        name = F.regexp_extract(x, r"^(.*?)(,([^,]*))?$", 1)
        return F.struct(F.trim(name).alias("theme"), F.coalesce(_num(F.regexp_extract(x, r",([^,]*)$", 1), "int"), F.lit(0)).alias("offset"))

    return F.transform(split_list(text), one)


def _location(parts: Column, at: int, shift: bool) -> Column:
    """A location from the parts at ``at``; ``shift``: the form without a second-level area."""
    get = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(at + i)), F.lit("")))
    lat_at, lon_at = (4, 5) if shift else (5, 6)
    coordinate = lambda i, most: exprs.once(_num(get(i), "double"), lambda x: F.coalesce(F.when(F.abs(x) <= most, x), F.lit(0.0)))
    return F.struct(
        _num(get(0), "int").alias("location_type"), get(1).alias("full_name"), get(2).alias("country_code"), get(3).alias("adm1"),
        (F.lit("") if shift else get(4)).alias("adm2"), coordinate(lat_at, 90.0).alias("latitude"), coordinate(lon_at, 180.0).alias("longitude"),
        get(lon_at + 1).alias("feature_id"), F.coalesce(_num(get(lon_at + 2), "int"), F.lit(0)).alias("char_offset"),
    )


def locations(text: Column) -> Column:
    """Blocks of seven parts or more with a type of 1 to 5, a name and a country; places out of range are 0.

    A coordinate that is no number drops its block; an empty one is 0.
    """
    blocks = F.transform(F.filter(split_list(text), lambda b: b.rlike("^[ \\t]*[1-5][ \\t]*#")), lambda b: F.split(b, "#", -1))
    number = lambda p, i: (F.trim(F.get(p, F.lit(i))) == "") | _num(F.get(p, F.lit(i)), "double").isNotNull()
    good = F.filter(blocks, lambda p: (F.size(p) >= 7) & F.coalesce(number(p, 5) & number(p, 6), F.lit(False)))
    made = F.transform(good, lambda p: _location(p, 0, False))
    return F.filter(made, lambda x: x["location_type"].between(1, 5) & (x["full_name"] != "") & (x["country_code"] != ""))


def counts(text: Column) -> Column:
    """Blocks of two parts or more with a kind and a whole number; a place if there are ten parts. Doubles stay."""
    blocks = F.transform(split_list(text), lambda b: F.split(b, "#", -1))

    def one(p: Column) -> Column:
        place = F.when(F.size(p) >= 10, _location(p, 3, True))
        return F.struct(F.trim(F.get(p, F.lit(0))).alias("count_type"), _num(F.get(p, F.lit(1)), "long").alias("number"), F.trim(F.coalesce(F.get(p, F.lit(2)), F.lit(""))).alias("object_type"), place.alias("location"))

    return F.filter(F.transform(F.filter(blocks, lambda p: F.size(p) >= 2), one), lambda x: x["number"].isNotNull() & (x["count_type"] != ""))


def tone(text: Column) -> Column:
    """Seven numbers, or all zero."""
    p = F.split(F.coalesce(text, F.lit("")), ",", -1)
    names = ["tone", "positive_pct", "negative_pct", "polarity", "activity_density", "self_group_ref", "word_count"]
    whole = F.size(p) >= 7
    return F.struct(*[F.coalesce(F.when(whole, _num(F.get(p, F.lit(i)), "int" if n == "word_count" else "double")), F.lit(0 if n == "word_count" else 0.0)).alias(n) for i, n in enumerate(names)])


def gkg_rows(lines: DataFrame) -> DataFrame:
    """Lines (a column ``value``) as 27 fields with a ``ts``, null where a line is bad."""
    rows = exprs.computed(lines.select("value"), f=exprs.once(F.split("value", "\t", -1), lambda f: F.when(F.size(f) >= GKG_COLUMNS, f)))
    return exprs.computed(rows, ts=F.try_to_timestamp(F.substring(F.get("f", F.lit(1)), 1, 14), F.lit("yyyyMMddHHmmss")))


def read_gkg(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of lines: too few fields or a bad date reject a line, with the reason."""
    rows = gkg_rows(lines)
    at = lambda i: F.get("f", F.lit(i))
    good = rows.where("f is not null and ts is not null").select(
        at(0).alias("record_id"), "ts", _num(at(2), "int").alias("source_collection"), at(3).alias("source_name"), at(4).alias("source_url"),
        split_list(at(7)).alias("themes"), named_offsets(at(8)).alias("enhanced_themes"), locations(at(10)).alias("locations"),
        split_list(at(11)).alias("persons"), named_offsets(at(12)).alias("enhanced_persons"), split_list(at(13)).alias("organizations"), tone(at(15)).alias("tone"),
        counts(at(5)).alias("counts"), at(26).alias("extras_xml"),
    )
    bad = rows.where("f is null or ts is null").select("value", F.when(F.col("f").isNull(), "too_few_fields").otherwise("bad_date").alias("reason"))
    return good, bad


def read_gkg_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_gkg(spark.read.text(path))


def parse_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.col("reason").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


def in_country(records: DataFrame, country: str) -> DataFrame:
    return records.where(F.exists("locations", lambda x: x["country_code"] == country))


def primary_location(places: Column, preferred: str | None = None) -> Column:
    """The preferred country's first place if it has one, else the first of the largest type."""
    best = F.get(F.filter(places, lambda x: x["location_type"] == F.array_max(F.transform(places, lambda y: y["location_type"]))), F.lit(0))
    return best if preferred is None else F.coalesce(F.get(F.filter(places, lambda x: x["country_code"] == preferred), F.lit(0)), best)


def text_filter(records: DataFrame, text: str) -> DataFrame:
    """Records in which a theme's label, a person, an organisation or the outlet contains the text."""
    low = text.lower()
    has = lambda c: F.exists(c, lambda x: F.lower(x).contains(low))
    return records.where(has("persons") | has("organizations") | F.lower("source_name").contains(low) | F.exists("themes", lambda x: F.lower(exprs.theme_label(x)).contains(low)))


def read_events(lines: DataFrame) -> DataFrame:
    """Event lines of 61 fields by place, with nulls for what is no number; the country in ISO codes."""
    f = F.split("value", "\t", -1)
    at = lambda i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit(""))
    rows = lines.where(F.size(f) >= EVENT_COLUMNS)
    return rows.select(
        _num(at(0), "long").alias("event_id"), F.try_to_timestamp(at(59), F.lit("yyyyMMddHHmmss")).alias("ts"), at(6).alias("actor1"), at(7).alias("actor1_country"), at(16).alias("actor2"), at(17).alias("actor2_country"),
        (_num(at(25), "int") == 1).alias("is_root_event"), F.coalesce(at(26), F.lit("000")).alias("event_code"), at(28).alias("root_code"), _num(at(29), "int").alias("quad_class"), _num(at(30), "double").alias("goldstein"),
        F.coalesce(_num(at(31), "int"), F.lit(0)).alias("num_mentions"), F.coalesce(_num(at(32), "int"), F.lit(0)).alias("num_sources"), F.coalesce(_num(at(33), "int"), F.lit(0)).alias("num_articles"), _num(at(34), "double").alias("avg_tone"),
        at(52).alias("location_name"), exprs.iso_country(at(53)).alias("country_code"), _num(at(56), "double").alias("latitude"), _num(at(57), "double").alias("longitude"), at(60).alias("source_url"),
    ).where("event_id is not null")


def read_conflicts(raw: DataFrame) -> DataFrame:
    """Conflict items (strings, as in ``schema.CONFLICT_JSON``) typed; fatalities only from digits, else 0."""
    digits = F.when(F.trim("fatalities").rlike(r"^\d+$"), _num(F.col("fatalities"), "int"))
    return raw.where("event_id_cnty is not null").select("event_id_cnty", _num(F.col("event_date"), "date").alias("event_date"), "event_type", "sub_event_type", "actor1", "actor2", "country", "region", "location", _num(F.col("latitude"), "double").alias("latitude"), _num(F.col("longitude"), "double").alias("longitude"), F.coalesce(digits, F.lit(0)).alias("fatalities"), "notes", "source")


def volume(text: Column) -> Column:
    """``200K+`` or ``1M+`` as a number; 0 if it is none."""
    clean = F.regexp_replace(F.upper(F.coalesce(text, F.lit("0"))), r"[+,\s]", "")
    scale = F.when(clean.endswith("M"), 1_000_000).when(clean.endswith("K"), 1_000).otherwise(1)
    return F.coalesce((_num(F.regexp_replace(clean, "[MK]$", ""), "double") * scale).cast("long"), F.lit(0).cast("long"))


def read_trends(items: DataFrame, most: int = 20) -> DataFrame:
    """Search items (country_code, position from 0, title, traffic): the first ``most`` places of each country, with a title."""
    return items.where((F.col("position") < most) & (F.trim("title") != "")).select("country_code", F.trim("title").alias("keyword"), (F.col("position") + 1).alias("rank"), volume(F.col("traffic")).alias("volume"))


# Titles that are not articles, and prefixes of such.
SKIPPED_TITLES = ["Main_Page", "Special:Search", "Wikipedia:Main_Page", "-", "Página_principal", "メインページ", "Заглавная_страница", "Portada", "Hauptseite", "Pagina_principale", "위키백과:대문"]
SKIPPED_PREFIXES = ["Special:", "Wikipedia:", "Especial:", "Spezial:"]


def editions_frame(spark: SparkSession, table: dict[str, str] = fixed.COUNTRY_EDITION) -> DataFrame:
    """(project, language, country_code): the edition that stands for each country."""
    return spark.createDataFrame([(f"{lang}.wikipedia", lang, country) for country, lang in table.items()], "project string, language string, country_code string")


def read_pageviews(raw: DataFrame, editions: DataFrame | None = None, most: int = 25) -> DataFrame:
    """Lists of most-viewed articles (``schema.PAGE_JSON`` and a day) to ranked rows a country that uses the edition.

    editions: project, language, country_code; by default those of the fixed table. Ranks are given anew after titles that are not articles are gone.
    """
    from pyspark.sql import Window

    editions = F.broadcast(editions_frame(raw.sparkSession)) if editions is None else editions
    rows = raw.select("day", F.explode("items").alias("i")).select("day", "i.project", F.posexplode("i.articles").alias("pos", "a")).select("day", "project", "pos", F.col("a.article").alias("article"), F.col("a.views").alias("views"))
    kept = rows.where((F.coalesce("article", F.lit("")) != "") & ~F.col("article").isin(SKIPPED_TITLES))
    for p in SKIPPED_PREFIXES:
        kept = kept.where(~F.col("article").startswith(p))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("day", "project").orderBy("pos"))).where(F.col("rank") <= most)
    return ranked.join(editions, "project").select("day", "country_code", "language", F.translate("article", "_", " ").alias("title"), "views", "rank")


def page_meta(pages: DataFrame) -> DataFrame:
    """Title and description of stored HTML, 500 characters each: the title element, else og:title; description, else og:description."""
    meta = lambda name: F.nullif(F.coalesce(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in (rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]*?content=[\"']([^\"']*)[\"']", rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*?(?:name|property)=[\"']{name}[\"']")]), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    cut = lambda x: F.substring(F.trim(x), 1, 500)
    return pages.select("page_id", "url", cut(F.coalesce(title, meta("og:title"))).alias("title"), cut(F.coalesce(meta("description"), meta("og:description"))).alias("description"))
