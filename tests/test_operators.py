"""Expectations for single rows: parsers, expressions, joins, graphs, sinks, streams."""

import math
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from signalweave.functions import exprs, fixed
from signalweave.operators import enrich, finding, happenings, heat, pairs, quality, rollups
from signalweave.plans.fixture import AS_OF, Tables
from signalweave.sources import normalize, parse, sinks
from signalweave.streaming import ingest, stream


def one(spark, column, **values):
    """The value of a column over one row of the given values."""
    names = list(values) or ["x"]
    kinds = ", ".join(f"{n} {'string' if values.get(n) is None or isinstance(values[n], str) else 'double' if isinstance(values[n], float) else 'boolean' if isinstance(values[n], bool) else 'array<string>' if isinstance(values[n], list) else 'long'}" for n in names)
    return spark.createDataFrame([tuple(values.get(n) for n in names)], kinds).select(column.alias("y")).first().y


LA = "3#Los Angeles, California, United States#US#USCA#CA037#34.0522#-118.244#1662328#1325"


@pytest.mark.parametrize(
    ("text", "n"),
    [("", 0), ("   ", 0), (LA, 1), (f"{LA};{LA}", 2), ("3#Short#US", 0), ("9#Name#US#a#b#1#2#f#1", 0), ("0#Name#US#a#b#1#2#f#1", 0), ("1##US###38#-97#US#1", 0), ("1#United States####38#-97#US#1", 0), ("1#United States#US###x#-97#US#1", 0), (f"bad;{LA};1#x", 1), ("4#São Paulo, Brasil#BR#BR27##-23.5#-46.6#1#9", 1)],
)
def test_location_blocks(spark, text, n):
    assert len(one(spark, parse.locations(F.col("t")), t=text)) == n


def test_location_values(spark):
    x = one(spark, parse.locations(F.col("t")), t=LA)[0]
    assert (x.location_type, x.country_code, x.adm1, x.adm2, x.latitude, x.longitude, x.feature_id, x.char_offset) == (3, "US", "USCA", "CA037", 34.0522, -118.244, "1662328", 1325)
    far = one(spark, parse.locations(F.col("t")), t="1#Land#US###95#-190#f#x")[0]
    assert (far.latitude, far.longitude, far.char_offset) == (0.0, 0.0, 0)
    empty = one(spark, parse.locations(F.col("t")), t="1#Land#US#####f#")[0]
    assert (empty.latitude, empty.longitude) == (0.0, 0.0)


def test_count_blocks(spark):
    text = "KILL#12##3#Pacific Palisades, California, United States#US#USCA#34.0481#-118.526#1661169;KILL#12#;BAD#x#;ONE;#5#"
    found = one(spark, parse.counts(F.col("t")), t=text)
    assert [(c.count_type, c.number, c.location and c.location.country_code) for c in found] == [("KILL", 12, "US"), ("KILL", 12, None)]
    assert found[0].location.latitude == 34.0481


def test_tone(spark):
    assert one(spark, parse.tone(F.col("t")), t="-1.5,2,3.5,4,5,6,70").tone == -1.5
    assert tuple(one(spark, parse.tone(F.col("t")), t="1,2")) == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)


def test_named_offsets(spark):
    assert [one(spark, exprs.iso_country(F.col("c")), c=c) for c in ("NG", "SE", "CD", "CF", "LI", "BY", "MI", "MP", "TO", "QQ", " ch", "")] == ["NE", "SC", "TD", "CG", "LR", "BI", "MW", "MU", "TG", "QQ", "CN", None]
    assert [tuple(x) for x in one(spark, parse.named_offsets(F.col("t")), t="A,B,5; C ;D,x")] == [("A,B", 5), ("C", 0), ("D", 0)]


def test_primary_location(spark):
    lines = spark.createDataFrame([("1#France#FR###46#2#f#1;4#Berlin#DE###52#13#f#1;2#Ohio#US###40#-82#f#1",)], "t string").select(parse.locations(F.col("t")).alias("l"))
    assert lines.select(parse.primary_location(F.col("l"))["country_code"]).first()[0] == "DE"
    assert lines.select(parse.primary_location(F.col("l"), "FR")["country_code"]).first()[0] == "FR"


@pytest.mark.parametrize(("url", "domain"), [("https://www.Example.com:80/a?b", "example.com"), ("washingtonpost.com/x", "washingtonpost.com"), ("", "Unknown"), (None, "Unknown"), ("http://user@news.site.org/", "news.site.org")])
def test_domain(spark, url, domain):
    assert one(spark, exprs.domain(F.col("u")), u=url) == domain


def test_headline(spark):
    title = lambda x, u: one(spark, exprs.headline(F.col("x"), F.col("u")), x=x, u=u)
    assert title("<PAGE_TITLE>One two three four</PAGE_TITLE>", "http://a.b/c") == "One two three four"
    assert title("<PAGE_TITLE>Too short</PAGE_TITLE>", "http://a.b/2024/some-news_here.html") == "Some News Here"
    assert title("<PAGE_TITLE>123456 two three four</PAGE_TITLE>", "http://a.b/plain") is None


def test_blocklist_needs_whole_labels(spark):
    is_blocked = lambda u: one(spark, exprs.blocked(F.col("u"), ["tabloid.com"]), u=u)
    assert is_blocked("https://www.tabloid.com/x") and is_blocked("https://celebs.tabloid.com/") and not is_blocked("https://nottabloid.com/")


def test_fips(spark):
    assert [one(spark, exprs.iso_country(F.col("c")), c=c) for c in ("UK", "GM", "CH", "SZ", "US")] == ["GB", "DE", "CN", "CH", "US"]


@pytest.mark.parametrize(("family", "method", "state", "label"), [("social", "x", False, "social_commentary"), ("gdelt", "reddit_public", True, "social_commentary"), ("ngo", "x", True, "humanitarian"), ("wire", "x", True, "state_media"), ("state", "x", False, "state_media"), ("wire", "x", False, "wire"), ("gdelt", "x", False, "reporting"), ("gdelt_translated", "x", False, "unknown"), (None, None, False, "unknown")])
def test_signal_class(spark, family, method, state, label):
    assert one(spark, exprs.signal_class(F.col("f"), F.col("m"), F.lit(state)), f=family, m=method) == label


def test_crisis(spark):
    c = one(spark, exprs.crisis(F.col("t")), t=["KILL", "ECON_TRADE"])
    assert (c.is_crisis, c.crisis_score, c.severity, c.event_type, c.crisis_themes) == (True, 0.7, "high", "violence", ["KILL"])
    none = one(spark, exprs.crisis(F.col("t")), t=["ECON_TRADE"])
    assert (none.is_crisis, none.crisis_score, none.severity, none.event_type) == (False, 0.0, "low", "other")


@pytest.mark.parametrize(("code", "label"), [("WB_633_ECONOMIC_STABILITY", "Economic Stability"), ("WB_2433_CONFLICT_AND_VIOLENCE", "Conflict & Violence (World Bank)"), ("crime", "Crime"), ("USPEC_POLICY_ECONOMIC1", "US Economic Policy"), ("USPEC_POLITICS_X", "US Politics"), ("CRISISLEX_C07_SAFETY", "Public Safety"), ("CRISISLEX_C03_DEAD", "Crisis: Dead"), ("UNGP_FOO_AND_BAR", "UN: Foo & Bar"), ("TAX_ETHNICITY_BASQUE", "Ethnicity: Basque"), ("ECON_DEBT", "Economic: Debt"), ("SOMETHING_NEW", "Something New")])
def test_theme_labels(spark, code, label):
    assert one(spark, exprs.theme_label(F.col("c")), c=code) == label


def test_search_texts(spark):
    plain = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()).split())
    for t in ("Žluťoučký kůň", "Đặng Thị Łódź", "ﬁne ½ ㎏ x²", "İstanbul", "Straße øre", "e\u0301a", "", "日本 abc", "ＦＵＬＬ①"):
        assert one(spark, exprs.search_text(F.col("t")), t=t) == plain(t)


def test_concepts_against_plain_code(spark):
    def fuzzy(words, targets):
        if not words or not targets:
            return 0.0
        total = 0.0
        for w in words:
            total += float(w in targets) if len(w) < 3 else 1.0 if any(w in x or x in w for x in targets) else max(SequenceMatcher(None, w, x).ratio() for x in targets)
        return total / len(words)

    low = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).split())
    words = lambda t: [w for w in re.split("[^a-z0-9]+", low(t)) if len(w) > 1]
    queries = ["war crimes", "viollence", "diamnts of blood", "narcotráfico en el norte", "kill", "zz", "el", "blood-diamonds"]
    got = {(r.query, r.slug): r.score for r in finding.fuzzy_concepts(spark.createDataFrame([(q,) for q in queries], "query string"), finding.concept_frame(spark)).collect()}
    near = {(r.query, r.slug): r.score for r in finding.closest_concepts(spark.createDataFrame([(q,) for q in queries], "query string"), finding.concept_frame(spark), 28).collect()}
    for q in queries:
        for slug, c in fixed.CONCEPTS.items():
            label = words(c["label"]) + words(slug.replace("-", " "))
            alias = [w for a in c["aliases"] for w in words(a)]
            phrase = max([0.0, *(2.0 if low(a) == low(q) else 1.5 for a in c["aliases"] if low(a) in low(q))])
            score = 10.0 if low(q) in (slug, slug.replace("-", " ")) else max(phrase, fuzzy(words(q), label + alias), 0.7 * fuzzy(words(q), words(c["description"])), 0.5 * fuzzy(words(q), [w for x in c["themes"] for w in words(x.replace("_", " "))]))
            assert math.isclose(got.get((q, slug), 0.0), score if score >= 0.7 else 0.0, abs_tol=2e-6), (q, slug)
            assert math.isclose(near.get((q, slug), 0.0), fuzzy(words(q), label), abs_tol=2e-6), (q, slug)


def test_ingest_again_leaves_the_same_tables(spark, tmp_path):
    line = "\t".join(["r1", "20240101120000", "1", "src.com", "https://src.com/a-long-title", "", "", "", "KILL,3;AB,1", "", LA, "", "joe doe,4", "", "", "-2,1,1,1,1,1,9"] + [""] * 11)
    lines = lambda *ls: spark.createDataFrame([(x,) for x in ls], "value string")
    sink, tables = ingest.signals_sink(str(tmp_path)), lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    sink(lines(line, "bad"), 0)
    other = line.replace("a-long-title", "b-long-title")
    for _ in range(2):  # the second time as after a failure
        sink(lines(line, other, other, line.replace("a-long", "c-long").replace("20240101", "20240102")), 1)
        assert tables("signals").count() == 3 and {(r.theme, r.signal_count) for r in tables("theme_hourly").where("day = '2024-01-01'").collect()} == {("KILL", 2)}
    sink(lines("bad"), 2)
    assert tables("country_hourly").agg(F.sum("signal_count")).first()[0] == 3


def test_query_country(spark):
    assert tuple(one(spark, exprs.query_country(F.col("q")), q="Protests in South Korea")) == ("KR", "protests")
    assert one(spark, exprs.query_country(F.col("q")), q="nothing here") is None
    assert one(spark, exprs.query_country(F.col("q")), q="in in Perú  peru") == ("PE", "in")
    assert one(spark, exprs.query_country(F.col("q")), q="Peru") == ("PE", "Peru")
    assert one(spark, exprs.country_code(F.col("q")), q="corea del sur africa") == "KR"
    some = {"a b": "1", "b c d": "2", "b": "3", "d e": "4"}
    assert [one(spark, exprs.country_code(F.col("q"), some), q=q) for q in ("a b c d e", "x b", "d e a b", "bc", "", None)] == ["2", "3", "1", None, None, None]
    assert one(spark, exprs.query_country(F.col("q"), some), q="to a b from b c d then") == ("2", "to a b then")


def test_query_country_makes_its_text_once(spark):
    for column in (exprs.query_country(F.col("q")), exprs.country_code(F.col("q"))):
        plan = spark.range(1).select(F.col("id").cast("string").alias("q")).select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[^a-z0-9]+") == 1
    runs = spark.range(1).select(exprs.word_runs(exprs.tokens(F.col("id").cast("string")), 3).alias("x"))
    once = spark.range(1).select(exprs.tokens(F.col("id").cast("string")).alias("x"))
    lower = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("lower(")
    assert lower(runs) == lower(once)


def test_search_text_and_variants(spark):
    assert one(spark, exprs.search_text(F.col("q")), q="  Inflación, Élections! ") == "inflacion elections"
    df = spark.createDataFrame([("USA",), ("red boats now",), ("orthohantavirus",), ("ladies",)], "query string")
    found = {}
    for r in finding.query_variants(df).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.variant)
    assert found["USA"] == ["usa", "us", "united states"]
    assert found["red boats now"][:3] == ["red boats now", "redboatsnow", "red boat now"] and "now red boats" in found["red boats now"]
    assert "hantavirus" in found["orthohantavirus"] and found["ladies"] == ["ladies", "lady"]


def test_fuzzy_dictionary_against_plain_code(spark):
    queries, entries = ["viollence now", "blood diamonds", "el"], [("violence", "violence and unrest"), ("gems", "diamond trade blood"), ("el", "el nino")]
    got = {(r.query, r.entry): r.score for r in finding.fuzzy_dictionary(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(entries, "entry string, text string"), 0.0).collect()}

    def plain(q, text):
        ws, total = text.split(), 0.0
        for x in q.split():
            total += float(x in ws) if len(x) < 3 else max(1.0 if x in w or w in x else SequenceMatcher(None, x, w).ratio() for w in ws)
        return total / len(q.split())

    for q in queries:
        for e, text in entries:
            assert math.isclose(got.get((q, e), 0.0), plain(q, text), abs_tol=1e-5), (q, e)


def test_fuzzy_suggestions(spark):
    s = spark.createDataFrame([(["angela merkel"],)] * 12 + [(["rare name"],)], "persons array<string>")
    countries = spark.createDataFrame([("DE", "germany")], "country_code string, name string")
    pages = spark.createDataFrame([("Angel_Merkal", 5)], "title string, views long")
    queries = spark.createDataFrame([("angela merkl",), ("germny",), ("zzz",)], "query string")
    got = {(r.query, r.value) for r in finding.fuzzy_suggest(queries, s, countries, pages).collect()}
    assert ("angela merkl", "angela merkel") in got and ("germny", "germany") in got and not any(q == "zzz" for q, _ in got)


def test_diversity_and_volume(spark):
    s = spark.createDataFrame([("A", f"s{i}") for i in range(21)] + [("B", "s0")] * 5, "country_code string, source_name string")
    got = {r.country_code: r for r in heat.source_diversity(s, "country_code").collect()}
    assert got["A"].diversity == 100.0 and abs(got["B"].diversity - 50 * math.log(2) / math.log(21)) < 1e-6
    rows = [("A", f"2024-01-{d:02d} 05:00:00") for d in range(24, 30) for _ in range(4)] + [("A", "2024-01-30 12:00:00")] * 12 + [("B", "2024-01-30 12:00:00")]
    v = spark.createDataFrame(rows, "country_code string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.country_code: r for r in heat.normalized_volume(v, "country_code", AS_OF).collect()}
    assert (got["A"].multiplier, got["A"].z, got["A"].level) == (3.0, 3.0, "high") and got["B"].multiplier is None and got["B"].level == "unknown"


@pytest.mark.parametrize(("z", "level"), [(3.01, "exceptional"), (3.0, "high"), (2.5, "high"), (2.0, "elevated"), (1.5, "elevated"), (1.0, "normal"), (0.0, "normal"), (-1.0, "normal"), (-1.01, "low"), (None, "unknown")])
def test_volume_levels(spark, z, level):
    assert one(spark, heat.volume_level(F.lit(z).cast("double")), x=1) == level


@pytest.mark.parametrize(
    ("local", "diversity", "n", "geo", "polyphony", "flags"),
    [
        (0.1, 0.5, 200, 0.9, 0.5, ["external_coverage"]), (0.0, 0.5, 200, 0.9, 0.5, []), (None, None, 60, None, None, ["wire_dominance"]), (0.5, 0.29, 49, 0.69, 0.5, ["wire_dominance", "thin_coverage"]),
        (0.5, 0.5, 101, 0.9, 0.29, ["echo_chamber"]), (0.5, 0.5, 100, 0.9, 0.29, []), (0.2, 0.3, 50, 0.5, 0.3, []), (0.5, 0.5, None, 0.5, 0.1, ["thin_coverage"]),
    ],
)
def test_heat_flags(spark, local, diversity, n, geo, polyphony, flags):
    lit = lambda v, kind: F.lit(v).cast(kind)
    assert one(spark, exprs.heat_flags(lit(local, "double"), lit(diversity, "double"), lit(n, "long"), lit(geo, "double"), lit(polyphony, "double")), x=1) == flags


@pytest.mark.parametrize(("name", "lang", "good"), [("G7", "en", True), ("EU", None, True), ("COVID 19", "en", True), ("2024", "en", False), ("x", "en", False), (" a ", "en", False), ("one two three four five six", "en", False), ("Дума", "en", False), ("Дума", "uk", False), ("دولة", "ar", True), ("José Pérez", "es", True), ("éèab", "fr", False), ("n" * 80, "en", True)])
def test_entities(spark, name, lang, good):
    assert one(spark, exprs.entity_valid(F.col("n"), F.lit(lang).cast("string")), n=name) == good


def test_entities_of_several_languages(spark):
    assert one(spark, exprs.entity_valid(F.col("n"), F.lit("fr"), multilingual=True), n="éèab")


def test_country_nodes(spark):
    """Three countries: one far over its baseline, one without a baseline, one without a place."""
    ts = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    rows = [("A", 1.0, "s1", "x")] * 40 + [("B", -2.0, "s1", "x")] * 10 + [("C", 0.0, "s2", "y")] * 50
    S = spark.createDataFrame(rows, "country_code string, sentiment double, source_name string, theme string").withColumn("ts", ts).withColumn("themes", F.array(F.upper("theme")))
    countries = spark.createDataFrame([("A", "Aland", 1.0, 2.0), ("B", None, 3.0, 4.0), ("C", "Cland", None, 5.0)], "country_code string, name string, latitude double, longitude double")
    baseline = spark.createDataFrame([("A", 8.0, 6.0)], "country_code string, avg_daily double, sd_daily double")
    nodes = lambda **how: {r.country_code: r for r in heat.country_nodes(S, rollups.country_hourly(S), rollups.country_daily(S), countries, baseline, AS_OF, **how).collect()}
    got = nodes(hours=24)
    assert set(got) == {"A", "B"} and (got["A"].heat, got["A"].level, got["A"].intensity) == (1.0, "critical", 0.8)  # z = (40 - 8) / 6, five times
    assert (got["B"].heat, got["B"].level, got["B"].name, got["B"].tone) == (0.2, "normal", "B", -0.2)
    focus = nodes(hours=24, focus=("theme", "x"))
    assert focus["A"].heat == 1.0 and focus["A"].level == "normal" and focus["B"].heat == 0.25
    assert set(nodes(range_name="1m", only=[" b"])) == {"B"} and nodes(hours=24, limit=1) == {}


def test_heat_stays_in_range(spark, small):
    rows = heat.country_heat(Tables(spark, small).signals, AS_OF, 240).collect()
    assert rows and all(-0.05 <= r.heat <= 1.0 for r in rows)


def test_dedup(spark):
    s = spark.createDataFrame([(3, "a"), (1, "a"), (2, "A"), (4, None), (5, None)], "signal_id long, source_url string")
    assert {r.signal_id for r in rollups.dedup_urls(s).collect()} == {1, 2}
    assert {r.signal_id for r in rollups.dedup_urls(s, keep_null_urls=True).collect()} == {1, 2, 4, 5}
    many = spark.range(10_000).select(F.col("id").alias("signal_id"), (F.col("id") % 5000).cast("string").alias("source_url"))
    assert rollups.dedup_urls(many).count() == 5000


def test_jaccard_is_exact(spark):
    sets = {"A": {"x", "y", "z"}, "B": {"y", "z", "w"}, "C": {"q"}}
    df = spark.createDataFrame([(o, e) for o, es in sets.items() for e in es], "o string, e string")
    assert [(r.a, r.b, r.shared, r.jaccard) for r in pairs.jaccard_pairs(df, "o", "e").collect()] == [("A", "B", 2, 0.5)]


def test_grid(spark):
    p = spark.createDataFrame([(0.0, 0.0, 1.0)], "latitude double, longitude double, intensity double")
    cells = pairs.grid_smooth(p, k=1).collect()
    assert len(cells) == 7 and sorted(c.intensity for c in cells) == [0.5] * 6 + [1.0]
    assert quality.violations(pairs.grid_smooth(p), quality.grid_rules(), "q").count() == 0


def test_chokepoints_and_boxes(spark):
    p = spark.createDataFrame([(26.6, 56.5), (0.0, 0.0)], "latitude double, longitude double")
    assert [r.chokepoint for r in happenings.nearest_chokepoint(p).collect()] == ["hormuz", None]
    boxes = spark.createDataFrame([("b", 20.0, 30.0, 50.0, 60.0)], "id string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert happenings.in_boxes(p, boxes).count() == 1


def test_aircraft(spark):
    kind = lambda c, h: one(spark, exprs.aircraft_class(F.col("c"), F.col("h"), ["RCH", "NAVY"], ["GAF"], ["ae"]), c=c, h=h)
    assert [kind("rch12", "a1"), kind("NAVY1", "a1"), kind("GAF1", "a1"), kind("X", "AE12"), kind("DLH44", "a1"), kind("N12", "a1")] == ["military", "military", "government", "military", "commercial", "private"]


def test_lexicon(spark):
    rows = [(1, "War and attack killed many", "en"), (2, "peace", "en"), (3, "Acuerdo de paz firmado hoy", "es"), (4, "nothing to see here", None), (5, "war war war war", "en")]
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    got = {r.id: (r.score, r.confidence) for r in enrich.lexicon_sentiment(df, "id", "t", "lang", enrich.lexicon_frame(spark)).collect()}
    assert got[1] == (-5.0, 0.5) and got[3] == (4.5, 0.45) and got[5] == (-5.0, 0.5) and 2 not in got and 4 not in got


def test_clusters(spark):
    df = spark.createDataFrame([(f"{w} story number {i % 3}",) for w in ("flood", "election", "market") for i in range(9)], "title string")
    rows = enrich.topic_clusters(df).collect()
    assert sum(r.n for r in rows) == 27 and sum(r.titles for r in rows) == 9 and all(0.5 <= r.confidence <= 0.95 for r in rows)


def test_sinks(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "signal_id long, source_url string")
    path = str(tmp_path / "t")
    sinks.append_new(new, path, "source_url")
    sinks.append_new(spark.createDataFrame([(9, "b"), (10, "c")], "signal_id long, source_url string"), path, "source_url")
    assert {(r.signal_id, r.source_url) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b"), (4, None), (10, "c")}
    sinks.export_csv(new, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_retention(spark, small):
    s = Tables(spark, small).signals
    stay, gone = sinks.drop_older(s, AS_OF, 10, enabled=True)
    assert stay.count() + gone.agg(F.sum("n")).first()[0] == s.count() and sinks.drop_older(s, AS_OF, 10, enabled=False)[0].count() == s.count()


def test_streamed_files(spark, tmp_path):
    line = "\t".join(["r1", "20240101120000", "1", "src.com", "https://src.com/a-long-title", "", "", "", "KILL,3;AB,1", "", LA, "", "joe doe,4", "", "", "-2,1,1,1,1,1,9"] + [""] * 11)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(line + "\nbad line\n")
    out = str(tmp_path / "out")
    stream.run_available(stream.stream_signals(spark, str(tmp_path / "in")), stream.update_log(out), str(tmp_path / "ck"))
    (tmp_path / "in" / "b.tsv").write_text(line.replace("a-long-title", "b-long-title"))
    q = stream.run_available(stream.stream_signals(spark, str(tmp_path / "in")), stream.update_log(out), str(tmp_path / "ck"))
    rows = spark.read.parquet(out).collect()
    assert sorted(r.headline for r in rows) == ["A Long Title", "B Long Title"] and {r.severity for r in rows} == {"high"}
    assert stream.batch_metrics(q)["rows"] >= 0


def test_feeds(spark):
    items = spark.createDataFrame([("<b>Quake in Chile</b>", "https://x.org/1", "Country: Chile", "2024-01-02 00:00:00"), ("Old", "https://x.org/2", "", "2023-01-01 00:00:00"), (None, "https://x.org/3", "", "2024-01-02 00:00:00")], "title string, link string, description string, ts string").withColumn("ts", F.to_timestamp("ts"))
    from dataclasses import replace

    feed = replace(normalize.FEEDS["humanitarian"], keywords=[("CL", "chile")])
    rows = normalize.normalize_articles(items, feed, F.to_timestamp(F.lit("2023-06-01"))).collect()
    assert [(r.headline, r.country_code, r.is_crisis, r.severity, r.signal_class) for r in rows] == [("Quake in Chile", "CL", True, "medium", "humanitarian")]


def test_host_suffixes_make_the_host_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("u")).select(exprs.host_suffixes(exprs.domain(F.col("u"))).alias("x"))
    one_host = spark.range(1).select(F.col("id").cast("string").alias("u")).select(exprs.domain(F.col("u")).alias("x"))
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")
    assert count(df) == count(one_host)
    assert one(spark, exprs.host_suffixes(F.col("h")), h="a.b.c") == ["a.b.c", "b.c", "c"]
