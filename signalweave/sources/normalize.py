"""Landed records to signals: one select over column expressions each, and one configuration for each feed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, fixed
from ..operators import matching
from . import parse
from .schema import SIGNALS

#: What a feed without an opinion gives.
EMPTY_TEXTS = "array<string>"


def conform(df: DataFrame) -> DataFrame:
    """All columns of a signal in their types, those that are missing as null."""
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SIGNALS).fields])


def with_crisis(df: DataFrame) -> DataFrame:
    """Crisis columns from the themes."""
    return exprs.computed(df, __c=exprs.crisis(F.col("themes"))).select(*[c for c in df.columns if c not in ("is_crisis", "crisis_score", "crisis_themes", "severity", "event_type")], "__c.*")


def signal_id(url: Column, ts: Column) -> Column:
    return F.xxhash64(url, ts)


def gkg_to_signals(records: DataFrame, source_lang: str = "en", blocked: list[str] | None = None) -> DataFrame:
    """Parsed records to signals: headline, first place with a country, ten themes and persons, tone, crisis, provenance.

    Records without a country, or of a blocked domain (by default those of the fixed list), go. Themes and persons keep the order in which they first appear.
    """
    iso = F.transform("locations", lambda x: F.struct(exprs.iso_country(x["country_code"]).alias("cc"), x["latitude"].alias("lat"), x["longitude"].alias("lon")))
    first = lambda xs: F.get(F.filter(xs, lambda x: (x["lat"] != 0) & (x["lon"] != 0)), F.lit(0))
    place = exprs.once(F.filter(iso, lambda x: x["cc"].isNotNull()), lambda xs: F.coalesce(first(xs), F.get(F.reverse(xs), F.lit(0))))
    # a name ends at its first comma
    names = lambda c, f: F.slice(F.array_distinct(F.filter(F.transform(c, lambda x: f(F.substring_index(x["theme"], ",", 1))), lambda x: F.length(x) > 2)), 1, 10)
    # each of these is parsed once, not again for every column that it gives
    rows = exprs.computed(records, p=place, themes=names("enhanced_themes", F.upper), persons=names("enhanced_persons", F.lower)).where("p is not null")
    rows = rows.where(~F.coalesce(exprs.blocked(F.col("source_url"), blocked), F.lit(False)))
    out = rows.select(
        signal_id(F.col("source_url"), F.col("ts")).alias("signal_id"), "ts", F.col("ts").alias("created_at"), F.upper("p.cc").alias("country_code"), F.nullif("p.lat", F.lit(0.0)).alias("latitude"), F.nullif("p.lon", F.lit(0.0)).alias("longitude"),
        F.col("tone.tone").alias("sentiment"), "source_url", "source_name", exprs.headline(F.col("extras_xml"), F.col("source_url")).alias("headline"), "themes", "persons",
        F.lit("gdelt").alias("source_family"), F.lit(source_lang).alias("source_lang"), F.lit(0.85).alias("geo_confidence"), F.lit("gdelt_gkg" if source_lang == "en" else "gdelt_gkg_translated").alias("attribution_method"),
        F.lit(False).alias("is_state_media"), exprs.outlet_country(F.col("source_url")).alias("source_origin_country"), F.lit("reporting").alias("signal_class"),
    )
    return conform(with_crisis(out))


@dataclass
class Feed:
    """How one feed's items become signals: its columns, and what its provenance is."""

    family: str = "rss"
    method: str = "rss_feed"
    geo_confidence: float = 0.6
    lang: str | None = "en"
    country: str | None = None  # where nothing else tells
    default_country: str | None = None
    provider_country: bool = False  # items name a country of two letters
    #: (country, comma-joined words): the first word, in this order, that title or text have tells the country
    keywords: list[tuple[str, str]] = field(default_factory=lambda: fixed.COUNTRY_WORDS)
    drop_without_country: bool = False
    crisis: bool = False
    state_media: bool = False
    most_chars: int = 500
    languages: dict[str, str] = field(default_factory=dict)
    title: str = "title"
    url: str = "link"
    text: str = "description"
    when: str = "ts"


FEEDS = {
    "rss": Feed(),
    "humanitarian": Feed(family="ngo", method="reliefweb_rss", geo_confidence=0.92, drop_without_country=True, crisis=True),
    "news_by_provider": Feed(family="api", method="newsdata_api", geo_confidence=0.7, provider_country=True, default_country="XX"),
    "news_by_words": Feed(family="api", method="newsapi", geo_confidence=0.65, default_country="XX"),
    "media_stack": Feed(family="api", method="mediastack", geo_confidence=0.65, provider_country=True, default_country="XX"),
    "social": Feed(family="social", method="reddit_public", geo_confidence=0.5, default_country="XX"),
}


def normalize_articles(items: DataFrame, feed: Feed, since: Column | None = None, blocked: list[str] = ()) -> DataFrame:
    """Items of a feed to signals. Items without a title or URL, removed posts, blocked domains and those before ``since`` go."""
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    url = F.coalesce(has("external_url"), F.col(feed.url))
    title = F.substring(exprs.strip_tags(F.col(feed.title)), 1, feed.most_chars)
    body = F.substring(exprs.strip_tags(has(feed.text)), 1, feed.most_chars)
    rows = items.where((F.coalesce(title, F.lit("")) != "") & url.isNotNull() & ~title.isin("[removed]", "[deleted]"))
    if since is not None:
        rows = rows.where(F.col(feed.when) > since)
    if blocked:
        rows = rows.where(~exprs.blocked(url, list(blocked)))
    both = F.concat_ws(" ", title, body)
    own = F.when(F.upper(has("provider_country")).rlike("^[A-Z]{2}$"), F.upper(has("provider_country"))) if feed.provider_country else F.lit(None).cast("string")
    tagged = F.regexp_extract(F.coalesce(has(feed.text), F.lit("")), r"Country:\s*([A-Za-z ]+)", 1) if feed.crisis else None
    by_words = matching.first_listed(both, feed.keywords) if feed.keywords else F.lit(None).cast("string")
    by_tag = matching.first_listed(tagged, feed.keywords) if tagged is not None and feed.keywords else F.lit(None).cast("string")
    country = F.coalesce(own, by_tag, by_words, *[F.lit(x) for x in (feed.country, feed.default_country) if x])
    lang = F.coalesce(exprs.dims.lookup(feed.languages, F.lower(has("language"))) if feed.languages else F.lower(has("language")), F.lit(feed.lang))
    state = F.lit(feed.state_media)
    out = rows.select(
        signal_id(url, F.col(feed.when)).alias("signal_id"), F.col(feed.when).alias("ts"), F.col(feed.when).alias("created_at"), country.alias("country_code"), url.alias("source_url"), exprs.domain(url).alias("source_name"), title.alias("headline"),
        F.array().cast(EMPTY_TEXTS).alias("themes"), F.array().cast(EMPTY_TEXTS).alias("persons"), F.lit(feed.family).alias("source_family"), lang.alias("source_lang"), F.lit(feed.geo_confidence).alias("geo_confidence"), F.lit(feed.method).alias("attribution_method"),
        state.alias("is_state_media"), exprs.outlet_country(url).alias("source_origin_country"), exprs.signal_class(F.lit(feed.family), F.lit(feed.method), state).alias("signal_class"),
        F.lit(feed.crisis).alias("is_crisis"), F.lit(0.5 if feed.crisis else 0.0).alias("crisis_score"), F.lit("medium" if feed.crisis else "low").alias("severity"), F.lit("humanitarian" if feed.crisis else "other").alias("event_type"),
    )
    return conform(out.where("country_code is not null") if feed.drop_without_country else out)


def combined(frames: list[DataFrame]) -> DataFrame:
    """Signals of several feeds as one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fixed_countries(df: DataFrame, column: str = "country_code") -> DataFrame:
    """Stored FIPS codes put right."""
    return df.withColumn(column, exprs.iso_country(F.col(column)))


def crisis_backfill(S: DataFrame) -> DataFrame:
    return with_crisis(S)


def read_and_normalize(lines: DataFrame, source_lang: str = "en") -> DataFrame:
    return gkg_to_signals(parse.read_gkg(lines)[0], source_lang)
