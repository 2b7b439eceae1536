"""Small reference tables as plain values, and helpers that make them columns or DataFrames.

Every operator that uses one takes it as a parameter, so larger tables can be passed in as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup(table: dict, key: Column) -> Column:
    """The value of a small dictionary for a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Prefixes that mark a theme as a crisis theme.
CRISIS_PREFIXES = [
    "CRISISLEX", "KILL", "WOUND", "ARREST", "KIDNAP", "TERROR", "MILITARY", "REBELLION", "INSURGENCY", "WAR",
    "CONFLICT", "VIOLENCE", "MASSACRE", "PROTEST", "RIOT", "DEMONSTRATION", "SEIZE", "BLOCKADE", "COUP", "IMPEACH",
    "ASSASSINATION", "POLITICAL_TURMOIL", "GOVT_COLLAPSE", "ELECTION_FRAUD", "MARTIAL_LAW", "NATURAL_DISASTER",
    "EARTHQUAKE", "FLOOD", "HURRICANE", "TYPHOON", "CYCLONE", "WILDFIRE", "DROUGHT", "TSUNAMI", "VOLCANO",
    "AVALANCHE", "LANDSLIDE", "TORNADO", "STORM", "REFUGEE", "FAMINE", "HUMANITARIAN", "EPIDEMIC", "PANDEMIC",
    "DISEASE_OUTBREAK", "DISPLACEMENT", "CYBER_ATTACK", "HOSTAGE", "BOMBING", "SHOOTING", "ATTACK", "EXPLOSIVE",
]
# Severity levels, the first that has a hit counts.
SEVERITY = {
    "critical": ["WAR", "MASSACRE", "GENOCIDE", "FAMINE", "PANDEMIC", "TSUNAMI", "ASSASSINATION"],
    "high": ["TERROR", "COUP", "EARTHQUAKE", "KILL", "HURRICANE", "TYPHOON", "HOSTAGE"],
    "medium": ["PROTEST", "RIOT", "FLOOD", "WILDFIRE", "CONFLICT", "MILITARY", "EPIDEMIC"],
    "low": ["DEMONSTRATION", "ARREST", "DROUGHT", "STORM"],
}
SEVERITY_BOOST = {"critical": 0.3, "high": 0.2, "medium": 0.1, "low": 0.0}
# Event types, the first that has a hit counts.
EVENT_TYPES = {
    "armed_conflict": ["WAR", "MILITARY", "CONFLICT", "REBELLION", "INSURGENCY"],
    "civil_unrest": ["PROTEST", "RIOT", "DEMONSTRATION", "STRIKE"],
    "terrorism": ["TERROR", "BOMBING", "ATTACK", "HOSTAGE"],
    "natural_disaster": ["EARTHQUAKE", "FLOOD", "HURRICANE", "TYPHOON", "WILDFIRE", "TSUNAMI", "VOLCANO", "TORNADO", "DROUGHT"],
    "political_crisis": ["COUP", "IMPEACH", "ASSASSINATION", "ELECTION_FRAUD"],
    "humanitarian": ["REFUGEE", "FAMINE", "DISPLACEMENT", "HUMANITARIAN"],
    "health_emergency": ["EPIDEMIC", "PANDEMIC", "DISEASE_OUTBREAK"],
    "violence": ["KILL", "WOUND", "MASSACRE", "SHOOTING"],
}
# Home countries of some outlets, a default for the parameter that takes the caller's whole table.
OUTLET_COUNTRY = {
    "cnn.com": "US", "nytimes.com": "US", "reuters.com": "US", "apnews.com": "US", "bloomberg.com": "US", "washingtonpost.com": "US",
    "bbc.co.uk": "GB", "bbc.com": "GB", "theguardian.com": "GB", "ft.com": "GB", "lemonde.fr": "FR", "france24.com": "FR",
    "dw.com": "DE", "spiegel.de": "DE", "rt.com": "RU", "tass.com": "RU", "xinhuanet.com": "CN", "cgtn.com": "CN",
    "aljazeera.com": "QA", "thehindu.com": "IN", "abc.net.au": "AU", "cbc.ca": "CA", "elpais.com": "ES", "clarin.com": "AR",
    "globo.com": "BR", "eltiempo.com": "CO", "news24.com": "ZA", "punchng.com": "NG", "haaretz.com": "IL", "scmp.com": "HK",
}
# Home countries of country-code top-level domains.
TLD_COUNTRY = {
    "uk": "GB", "fr": "FR", "de": "DE", "ru": "RU", "cn": "CN", "ir": "IR", "in": "IN", "au": "AU", "ca": "CA", "br": "BR",
    "mx": "MX", "jp": "JP", "kr": "KR", "eg": "EG", "ng": "NG", "za": "ZA", "tr": "TR", "pk": "PK", "il": "IL", "ua": "UA",
    "pl": "PL", "ar": "AR", "ve": "VE", "co": "CO", "cl": "CL",
}
# Regions of countries by ISO code.
REGIONS = {
    "North America": ["US", "CA"],
    "Latin America": ["MX", "BR", "AR", "CO", "CL", "PE", "VE", "EC", "BO", "PY", "UY", "CU"],
    "Europe": ["GB", "DE", "FR", "IT", "ES", "PL", "NL", "BE", "SE", "NO", "CH", "AT", "PT", "GR", "CZ", "HU", "RO", "UA", "RU", "FI", "DK", "SK", "BG", "HR", "RS"],
    "Middle East": ["SA", "IR", "IL", "TR", "AE", "IQ", "SY", "JO", "LB", "KW", "QA", "YE", "OM", "PS", "BH"],
    "Asia": ["CN", "JP", "IN", "KR", "ID", "PK", "BD", "VN", "TH", "MY", "PH", "TW", "SG", "MM", "KZ", "UZ", "AF", "NP", "LK"],
    "Africa": ["NG", "ZA", "EG", "ET", "KE", "GH", "TZ", "DZ", "MA", "AO", "MZ", "CI", "MG", "CM", "SN"],
    "Oceania": ["AU", "NZ"],
}
# Straits and canals (id, latitude, longitude, radius in km), in order.
CHOKEPOINTS = [
    ("hormuz", 26.6, 56.5, 130.0), ("bosphorus", 41.1, 29.0, 80.0), ("suez", 30.4, 32.4, 110.0), ("bab_el_mandeb", 12.6, 43.4, 140.0),
    ("malacca", 2.5, 101.5, 260.0), ("taiwan", 24.5, 120.5, 190.0), ("panama", 9.0, -79.5, 85.0), ("good_hope", -34.0, 18.5, 220.0),
    ("english_channel", 51.0, 1.5, 230.0), ("south_china_sea", 7.0, 113.0, 650.0),
]
# Aliases of search texts.
SEARCH_ALIASES = {
    "ee uu": ["us", "usa", "united states"], "eeuu": ["us", "usa", "united states"], "u s": ["us", "usa", "united states"],
    "usa": ["us", "united states"], "orthohantavirus": ["hantavirus"], "aviones": ["aircraft", "planes"], "aeronaves": ["aircraft", "planes"],
    "barcos": ["ships", "vessels", "maritime"], "buques": ["ships", "vessels", "maritime"],
}
# Themes by category.
THEME_CATEGORIES = {
    "security": ["TAX_TERROR", "ARMEDCONFLICT", "CRISISLEX_C03_DEAD_WOUNDED", "CRISISLEX_C06_VIOLENCE", "CRIME", "ARREST", "KILL", "MILITARY", "SEIZE", "CYBERATTACK"],
    "economy": ["TAX_FNCACT", "ECON_INFLATION", "ECON_TRADE", "ECON_BANKRUPTCY", "WB_633_ECONOMIC_STABILITY", "AGRICULTURE", "ENERGY", "LABOR", "STRIKE"],
    "politics": ["LEADER", "ELECTION", "GOVERNMENT", "PROTEST", "CORRUPTION", "TAX_DIPLOMACY", "WB_632_WOMEN_IN_POLITICS", "SANCTION", "TREATY", "COURT", "INVESTIGATION"],
    "environment": ["ENV_CLIMATECHANGE", "ENV_FORESTS", "ENV_POLLUTION", "UNGP_DISASTER", "DISASTER_RESPONSE"],
    "health": ["HEALTH"],
    "social": ["EDUCATION", "HUMAN_RIGHTS", "MIGRATION", "RELIGION", "SOC_POINTSOFVIEW"],
    "media": ["MEDIA_MSM"],
    "technology": ["TECHNOLOGY", "SPACE"],
    "infrastructure": ["TRANSPORT"],
    "culture": ["SPORTS", "ENTERTAINMENT"],
}
# Patterns of titles that are noise for public attention.
ATTENTION_NOISE = [
    "NFL|NBA|MLB|NHL|FIFA|UFC|ESPN|MLS|Premier League|Champions League|World Series|Super Bowl",
    "actor|actress|singer|rapper|celebrity|filmography|discography|reality television|television personality",
    "Oscar|Grammy|Emmy|Billboard|box office|red carpet|paparazzi|streaming series",
    "Kardashian|Taylor Swift|Bieber|Beyonce|Drake|LeBron|Messi|Ronaldo",
    "horoscope|zodiac|recipe|crossword|wedding|sneaker|shopping guide|discount code",
]
