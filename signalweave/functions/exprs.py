"""Scalar column expressions: text, URLs, places, time, provenance. All native; nulls give null unless stated."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims, fixed


def any_of(words: list[str]) -> str:
    """A pattern that matches any of the words literally."""
    return "|".join("".join("\\" + c if not c.isalnum() and c not in " _" else c for c in w) for w in words)


def once(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row.

    A plain projection may be merged into each later use, filters too, and then does its work several times; a generator is not.
    """
    made = df.select("*", F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("__once"))
    return made.select(*[c for c in df.columns if c not in columns], *[F.col(f"__once.{n}").alias(n) for n in columns])


# Text and URLs


def domain(url: Column) -> Column:
    """Host of a URL or bare host, in lower case, without port and a leading ``www.``; ``Unknown`` for empty or null."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1)
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "Unknown").otherwise(F.regexp_replace(host, r"^www\.", ""))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains, longest first."""
    return once(F.split(host, r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def slug_title(url: Column) -> Column:
    """A headline from the last part of a URL's path, if that has five letters and a dash or underscore."""
    slug = F.element_at(F.split(F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/]*([^?#]*)", 1), "^/+|/+$", ""), "/"), -1)
    words = F.initcap(F.regexp_replace(F.regexp_replace(slug, r"\.html?|\.php", ""), "[-_]", " "))
    return F.when((F.length(slug) >= 5) & slug.rlike("[-_]"), words)


def headline(extras: Column, url: Column) -> Column:
    """The page title if it has four words and doesn't start with six digits, else the URL's slug."""
    title = F.trim(F.regexp_extract(extras, "<PAGE_TITLE>(.+?)</PAGE_TITLE>", 1))
    good = (F.size(F.split(title, r"\s+")) >= 4) & ~title.rlike(r"^\d{6,}")
    return F.coalesce(F.when(good, title), slug_title(url))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


@cache
def _ascii_forms() -> tuple[dict[str, str], dict[str, str], str, str]:
    """By the compatibility decomposition: characters that become one ASCII letter or digit, those that become several characters, what
    becomes nothing (marks), and a pattern of a few ranges around the second kind."""
    single, several, marks, spans = {}, {}, [], []
    for c in map(chr, range(0x80, 0x30000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            marks.append(c)
        elif plain != c and any(x.isascii() and x.isalnum() for x in plain):
            (single if len(plain) == 1 else several)[c] = plain
    for c in map(ord, several):
        if spans and c - spans[-1][1] <= 64:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return single, several, "".join(marks), "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def unmarked(text: Column) -> Column:
    """Lower case, letters without marks: they are taken apart (compatibility form), so what has an ASCII base keeps that."""
    single, several, marks, rare = _ascii_forms()
    # characters beyond the replacements are marks, which translate drops
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "".join(single) + marks, "".join(single.values()))).otherwise(text)
    table = F.map_from_arrays(F.lit(list(several)), F.lit(list(several.values())))
    whole = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(c.rlike(rare), F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")
    marked = F.lower(F.when(plain.rlike(rare), whole).otherwise(plain))
    # the class of rare letters is long; ASCII texts don't meet it
    return F.when(text.rlike(r"[^\x00-\x7F]"), marked).otherwise(F.lower(text))


def search_text(text: Column) -> Column:
    """Lower case, without marks on letters, everything else but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(unmarked(text), "[^a-z0-9]+", " "))


def search_words(text: Column) -> Column:
    """Words of two letters or more of a search text."""
    return F.filter(F.split(search_text(text), " "), lambda w: F.length(w) > 1)


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.endswith("virus"), token)
        .when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, 1, n - 3), F.lit("y")))
        .when((n > 4) & token.endswith("es"), F.substring(token, 1, n - 2))
        .when((n > 3) & token.endswith("s"), F.substring(token, 1, n - 1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def script(text: Column) -> Column:
    return F.when(text.rlike(r"[؀-ۿ]"), "arabic").when(text.rlike("[A-Za-z]"), "latin").otherwise("other")


def language_hint(text: Column, lang: Column, supported: list[str] | None = None) -> Column:
    """The stated language, if it is one of the supported ones (all, if none are given), else Arabic by its script, else English."""
    stated = F.lower(lang) if supported is None else F.when(F.lower(lang).isin(supported), F.lower(lang))
    return F.coalesce(stated, F.when(script(text) == "arabic", "ar").otherwise("en"))


def clean_title(title: Column) -> Column:
    """White space as single spaces, at most 100 characters; null under three."""
    short = F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, 100)
    return F.when(F.length(short) >= 3, short)


def theme_words(code: Column) -> Column:
    """A code's words: ``_AND_`` as &, underscores as spaces, capitals first, some names set right."""
    words = F.regexp_replace(F.regexp_replace(code, "_AND_", " & "), "_", " ")
    words = F.trim(F.initcap(F.regexp_replace(F.regexp_replace(words, r"\b([A-Z]+)\d+\b", "$1"), r"\s+", " ")))
    for raw, good in (("Anti Corruption", "Anti-Corruption"), ("Nondefense", "Non-Defense"), ("Non Defense", "Non-Defense"), ("Un", "UN"), ("Us", "US")):
        words = F.regexp_replace(words, rf"\b{raw}\b", good)
    return words


#: Prefixes of theme codes and what their labels start with, in order.
LABEL_RULES = [
    (r"^USPEC_POLICY_ECONOMIC.*", None, "US Economic Policy"), (r"^USPEC_POLICY.*", None, "US Policy"), (r"^USPEC_POLITICS.*", None, "US Politics"),
    (r"^USPEC_", "US ", None), (r"^EPU_", "Policy: ", None), (r"^CRISISLEX_(C\d+_)?", "Crisis: ", None), (r"^UNGP_", "UN: ", None),
    (r"^TAX_FNCACT_", "", None), (r"^TAX_ETHNICITY_", "Ethnicity: ", None), (r"^(TAX_)?WORLDLANGUAGES_", "Language: ", None), (r"^TAX_", "", None),
    (r"^SOC_", "", None), (r"^GENERAL_", "", None), (r"^MEDIA_?", "", None), (r"^ENV_", "", None), (r"^ECON_", "Economic: ", None),
    (r"^GOV_", "Government: ", None), (r"^TECH_", "Technology: ", None), (r"^ENERGY_", "Energy: ", None),
]


def theme_label(theme: Column, named: dict[str, str] | None = None) -> Column:
    """A label: its name in the taxonomy, else a name of its own if it has one, else by the first prefix that fits, else its words."""
    code = F.upper(theme)
    own = {"CRISISLEX_C07_SAFETY": "Public Safety", "CRISISLEX_CRISISLEXREC": "Crisis Event", "UNGP_FORESTS_RIVERS_OCEANS": "Environment"} | (named or {})
    out = F.when(code.rlike("^WB_"), F.concat(theme_words(F.regexp_replace(code, r"^WB_(\d+_)?", "")), F.lit(" (World Bank)")))
    for pattern, start, whole in LABEL_RULES:
        out = out.when(code.rlike(pattern), F.lit(whole) if whole else F.concat(F.lit(start), theme_words(F.regexp_replace(code, pattern, ""))))
    return F.coalesce(dims.lookup(fixed.THEME_LABELS, theme), dims.lookup(own, code), out.otherwise(theme_words(code)))


def simple_label(theme: Column) -> Column:
    """Without a prefix of two known kinds and numbers, capitals first."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.upper(theme), r"^(WB_\d+_|TAX_[A-Z]+_|CRISISLEX_[A-Z0-9]+_|UNGP_|ECON_|ENV_|SOC_)", ""), r"[_\d]+", " ")))


def theme_category(theme: Column) -> Column:
    return F.coalesce(dims.lookup({t: c for c, ts in dims.THEME_CATEGORIES.items() for t in ts}, F.upper(theme)), F.lit("other"))


def gram_set(text: Column) -> Column:
    """Trigrams of each word, with two blanks before and one after, each once."""
    words = F.filter(F.split(search_text(text), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 if there are none."""
    x, y = gram_set(a), gram_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


# Places


def iso_country(fips: Column, table: dict[str, str] | None = None) -> Column:
    """The ISO code of a FIPS code; a code that is the same in both, or unknown, stays as it is. Null for empty or null."""
    code = F.substring(F.trim(F.upper(F.nullif(fips, F.lit("")))), 1, 2)
    return F.coalesce(dims.lookup(table or fixed.FIPS_TO_ISO, code), code)


def first_keyword(text: Column, patterns: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The value of the first pattern, in order, that a text matches."""
    out = reduce(lambda w, p: (F if w is None else w).when(text.rlike(p[0]), p[1]), patterns, None)
    return out.otherwise(default) if default is not None else out


def outlet_country(url: Column, outlets: dict[str, str] | None = None, tlds: dict[str, str] | None = None) -> Column:
    """An outlet's home: its domain's or the longest known parent domain's, else its country-code domain's."""
    host = domain(url)
    known = F.transform(host_suffixes(host), lambda h: dims.lookup(outlets or dims.OUTLET_COUNTRY, h))
    return F.coalesce(F.get(F.array_compact(known), F.lit(0)), dims.lookup(tlds or dims.TLD_COUNTRY, F.element_at(F.split(host, r"\."), -1)))


def source_family(url: Column, families: dict[str, str] | None = None) -> Column:
    host = domain(url)
    state = reduce(lambda a, b: a | b, [host.endswith(s) for s in fixed.STATE_SUFFIXES])
    return F.coalesce(dims.lookup(families or fixed.SOURCE_FAMILY, host), F.when(state, "state").otherwise("independent"))


def region(country: Column, regions: dict[str, list[str]] | None = None) -> Column:
    return dims.lookup({c: r for r, cs in (regions or dims.REGIONS).items() for c in cs}, F.upper(country))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def word_runs(words: Column, longest: int) -> Column:
    """Runs of one to ``longest`` neighbouring words, joined by a space."""

    def runs(ws: Column, shorter: Column, n: int) -> Column:
        if n > longest:
            return F.array().cast("array<string>")
        # a run is a shorter one and the word after it; where no word follows it is null
        longer = F.zip_with(shorter, F.slice(ws, n, F.greatest(F.size(ws), F.lit(0))), lambda run, w: F.concat(run, F.lit(" "), w))
        return once(F.array_compact(longer), lambda x: F.concat(x, runs(ws, x, n + 1)))

    # the words are made once, not again for each place and length
    return once(words, lambda ws: F.concat(ws, runs(ws, ws, 2)))


def _longest_of(words: list[str]) -> str:
    """A pattern for any of the words, longer ones first, that tells them apart letter by letter."""
    heads = sorted({w[0] for w in words if w})
    rest = "|".join(h + _longest_of([w[1:] for w in words if w[:1] == h]) for h in heads)
    return (f"(?:{rest})" + ("?" if "" in words else "")) if rest else ""


def named_alias(q: Column, aliases: dict[str, str]) -> Column:
    """The longest alias among the words of a search text, of equal length the first; null if none.

    One pattern tells the longest alias from each word on, so a text is made and read once, however many words and aliases there are.
    """
    good = [a for a in aliases if re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", a)]
    found = F.regexp_extract_all(q, F.lit(r"\b(?=(" + (_longest_of(good) or "(?!)") + r")\b)"), F.lit(1))
    order = {a: i for i, a in enumerate(aliases)}
    return F.array_min(F.transform(found, lambda w: F.struct((-F.length(w)).alias("l"), dims.lookup(order, w).alias("i"), w.alias("alias"))))["alias"]


def country_code(query: Column, aliases: dict[str, str] | None = None) -> Column:
    """The code alone of ``query_country``."""
    aliases = fixed.COUNTRY_ALIASES if aliases is None else aliases
    return dims.lookup(aliases, named_alias(search_text(query), aliases))


def query_country(query: Column, aliases: dict[str, str] | None = None) -> Column:
    """(code, topic): the country whose longest alias a query names, and the query without it; null if none. Of equal length the first counts."""
    aliases = fixed.COUNTRY_ALIASES if aliases is None else aliases

    def split(q: Column, best: Column) -> Column:
        # each word has blanks of its own, so an alias is replaced as plain text
        apart = lambda x: F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
        marked = F.replace(apart(q), apart(best), F.lit(" \x01 "))
        rest = F.trim(F.regexp_replace(F.regexp_replace(marked, "( (en|in|de|del|sobre|from|about) )? \x01 ", " "), " +", " "))
        return F.when(best.isNotNull(), F.struct(dims.lookup(aliases, best).alias("code"), F.when(F.length(rest) >= 2, rest).otherwise(query).alias("topic")))

    return once(search_text(query), lambda q: once(named_alias(q, aliases), lambda best: split(q, best)))


# Labels and scores


def tone_label(tone: Column) -> Column:
    return F.when(tone < -10, "very_negative").when(tone < -2, "negative").when(tone <= 2, "neutral").when(tone <= 10, "positive").when(tone > 10, "very_positive")


def framing_label(tone: Column) -> Column:
    return F.when(tone > 0.5, "positive").when(tone > -0.5, "neutral").when(tone > -2, "negative").when(tone <= -2, "hostile")


def precision(location_type: Column) -> Column:
    return F.when(location_type == 1, "country").when(location_type.isin(2, 5), "region").when(location_type.isin(3, 4), "city").otherwise("unknown")


def clamped_tone(tone: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tone / 10.0))


def decay(earlier: Column, later: Column, half_hours: float = 6.0) -> Column:
    """exp(-hours / scale); a time ahead counts as now."""
    hours = (later.cast("double") - earlier.cast("double")) / 3600.0
    return F.exp(-F.greatest(hours, F.lit(0.0)) / half_hours)


def crisis_themes(themes: Column) -> Column:
    return F.filter(F.coalesce(themes, F.array().cast("array<string>")), lambda t: F.upper(t).rlike(any_of(dims.CRISIS_PREFIXES)))


def _first_hit(themes: Column, table: dict[str, list[str]], default: str) -> Column:
    return once(F.upper(F.array_join(themes, " ")), lambda joined: first_keyword(joined, [(any_of(words), name) for name, words in table.items()], F.lit(default)))


def crisis(themes: Column) -> Column:
    """(is_crisis, crisis_score, crisis_themes, severity, event_type) of a row's themes."""
    return once(themes, lambda ts: once(crisis_themes(ts), lambda found: _crisis(ts, found)))


def _crisis(themes: Column, found: Column) -> Column:
    some = F.size(found) > 0
    score = F.least(F.lit(1.0), F.try_divide(F.size(found), F.size(themes)) + dims.lookup(dims.SEVERITY_BOOST, _first_hit(found, dims.SEVERITY, "low")))
    return F.struct(
        some.alias("is_crisis"),
        F.when(some, score).otherwise(0.0).alias("crisis_score"),
        found.alias("crisis_themes"),
        F.when(some, _first_hit(themes, dims.SEVERITY, "low")).otherwise("low").alias("severity"),
        F.when(some, _first_hit(themes, dims.EVENT_TYPES, "other")).otherwise("other").alias("event_type"),
    )


def signal_class(family: Column, method: Column, state_media: Column) -> Column:
    return (
        F.when((method == "reddit_public") | (family == "social"), "social_commentary")
        .when((method == "reliefweb_ocha") | (family == "ngo"), "humanitarian")
        .when(F.coalesce(state_media, F.lit(False)) | (family == "state"), "state_media")
        .when(family == "wire", "wire")
        .when(family.isin("gdelt", "rss", "api", "independent"), "reporting")
        .otherwise("unknown")
    )


def aircraft_class(callsign: Column, icao24: Column, military: list[str] = fixed.MILITARY_PREFIXES, government: list[str] = fixed.GOVERNMENT_PREFIXES, hex_ranges: list[str] = fixed.MILITARY_ADDRESSES) -> Column:
    """Prefixes of two to four letters first, then the address range, then the form of airline callsigns.

    Only prefixes of these lengths are compared, so longer ones of the lists never apply.
    """
    cs = F.upper(F.trim(callsign))
    starts = lambda names, sizes: reduce(lambda a, b: a | b, [F.substring(cs, 1, n).isin(names) for n in sizes])
    return (
        F.when(starts(military, (2, 3, 4)), "military")
        .when(starts(government, (3, 4)), "government")
        .when(F.lower(F.substring(icao24, 1, 2)).isin(hex_ranges), "military")
        .when(cs.rlike(r"^[A-Z]{2,3}\d"), "commercial")
        .otherwise("private")
    )


def intensity(counts: Column) -> Column:
    """All theme counts of a map over 500, at most 1."""
    return F.least(F.lit(1.0), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x) / 500.0)


def source_confidence(has_url: Column, has_name: Column, has_time: Column) -> Column:
    return F.round(F.when(has_url, 0.7).otherwise(0.0) + F.when(has_name, 0.15).otherwise(0.0) + F.when(has_time, 0.15).otherwise(0.0), 2)


def conflict_intensity(goldstein: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - goldstein / 10.0)), 2)


def gated_tone(nlp_tone: Column, tone: Column, nlp_n: Column, n: Column, least: float = 0.5) -> Column:
    """The model's mean tone where the model has seen enough of the rows."""
    return F.when(F.try_divide(nlp_n, n) >= least, nlp_tone).otherwise(tone)


def signed_score(labels: Column) -> Column:
    """(score, confidence) of a map of label probabilities: 5 * (positive - negative), and the largest."""
    p = lambda k: F.coalesce(F.try_element_at(labels, F.lit(k)), F.lit(0.0))
    return F.struct((5.0 * (p("positive") - p("negative"))).alias("score"), F.array_max(F.map_values(labels)).alias("confidence"))


def heat_flags(local_voice: Column, diversity: Column, volume: Column, geo_confidence: Column, polyphony: Column) -> Column:
    """Warnings about a country's heat, by its parts: little local voice (missing or 0: 0.5), few families, thin coverage, one frame for many rows."""
    known = lambda x, default: F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))
    n = F.coalesce(volume, F.lit(0))
    return F.array_compact(
        F.array(
            F.when(known(local_voice, 0.5) < 0.2, "external_coverage"),
            F.when(F.coalesce(diversity, F.lit(0.0)) < 0.3, "wire_dominance"),
            F.when((n < 50) & (known(geo_confidence, 1.0) < 0.7), "thin_coverage"),
            F.when((known(polyphony, 1.0) < 0.3) & (n > 100), "echo_chamber"),
        )
    )


# Predicates


def in_window(ts: Column, as_of: str, hours: float, end_hours: float = 0) -> Column:
    """ts in (as_of - hours, as_of - end_hours], both before ``as_of``."""
    end = F.to_timestamp(F.lit(as_of))
    minutes = lambda h: F.expr(f"INTERVAL {int(h * 60)} MINUTES")
    return (ts > end - minutes(hours)) & (ts <= end - minutes(end_hours))


def focus(kind: str, value: str) -> Column:
    """Rows about a theme, person, country or source."""
    low = value.lower()
    return {
        "theme": lambda: F.array_contains("themes", value),
        "person": lambda: F.exists("persons", lambda p: F.lower(p).contains(low)),
        "country": lambda: F.col("country_code") == value,
        "source": lambda: F.lower("source_name").contains(low),
    }[kind]()


def like_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike(any_of([w.lower() for w in words]))


def blocked(url: Column, domains: list[str] | None = None) -> Column:
    """Whether the host is one of the domains or below one."""
    return F.exists(host_suffixes(domain(url)), lambda h: h.isin(fixed.BLOCKED_DOMAINS if domains is None else list(domains)))


def valid_person(name: Column, places: list[str] = fixed.PLACE_NAMES, first_words: list[str] = fixed.PLACE_FIRST_WORDS) -> Column:
    """Two words or more, 60 letters at most, no place's name and no first word of such."""
    words = F.split(F.lower(F.trim(name)), r"\s+")
    return (F.size(words) >= 2) & (F.length(name) <= 60) & ~F.lower(name).isin(list(places)) & ~F.get(words, F.lit(0)).isin(list(first_words))


def attention_relevant(title: Column) -> Column:
    return ~F.regexp_replace(title, "_", " ").rlike(r"(?i)\b(" + "|".join(dims.ATTENTION_NOISE) + r")\b")


def entity_valid(text: Column, lang: Column, multilingual: bool = False) -> Column:
    """Two letters or more, not only digits, at most five words; in languages of Latin script few letters beyond ASCII.

    Few: under 0.4 of the letters, or 0.6 where models for several languages are in use.
    """
    t = F.trim(text)
    foreign = F.regexp_count(t, F.lit(r"[^\x00-\x7F]")) / F.greatest(F.length(t), F.lit(1))
    latin = ~F.lower(F.coalesce(lang, F.lit(""))).isin(fixed.NON_LATIN_LANGUAGES)
    return (F.length(t) >= 2) & ~t.rlike(r"^\p{Nd}+$") & (F.size(F.split(t, r"\s+")) <= 5) & (~latin | (foreign < (0.6 if multilingual else 0.4)))
