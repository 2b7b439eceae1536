"""The ten operators: odd inputs, plain versions, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import bpe, brown, compression, language_id, mixing, quality_rules, queries, secrets, simhash, topk, toxicity
from signalweave.llm.automaton import Automaton, build
from signalweave.llm.common import checkpointed, held_out, most_frequent
from signalweave.llm.components import components

from . import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, extra array<int>"
LONG = "word another thing " * 7000 + "końiec"
ODD = [
    (0, None, None, None), (1, "", "en", "a"), (2, "   \t\n ", "en", "a"), (3, "one", "en", "a"), (4, "one", "en", "a"), (5, "ONE", None, "b"), (6, LONG, "en", "b"), (7, LONG + " tail", "en", None),
    (8, "la maison est dans le jardin de la ville et le chat dort " * 3, "fr", "c"), (9, "the house is in the garden of the town and the cat sleeps " * 3, "en", "c"), (None, "no id here at all, just words", "en", "c"),
    (10, "12345 !!! ???", "en", "a"), (11, "a b\x1cc d 🙂🙂 \x00 e", "en", "a"), (12, "password = 'hunter22' AKIA" + "A" * 16 + " " + "0a" * 15, "en", "a"), (12, "same id twice", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, s, 5, 0.5, "x", [1]) for i, t, g, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return {r.doc_id: r for r in docs.collect()}


# 1


def test_language_id(spark, small, local):
    rows = queries.op1_language_id(spark, small).collect()
    assert len(rows) == len(local) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.n_letters >= 20]
    assert all(r.held_out == (plain.crc(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == local[r.doc_id].lang for r in held]) > 0.97


def test_language_id_odd(spark, odd):
    model = language_id.fit(odd)
    rows = language_id.identify(odd, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(ODD)
    none = [r for r in rows if r.lang_pred == "und"]
    assert {r.doc_id for r in none} == {0, 1, 2, 10} and all(r.score == 0 and r.ambiguous for r in none)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (8, 9)} == {8: "fr", 9: "en"}
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert language_id.accepted(odd, model).columns == odd.columns
    empty = language_id.fit(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, empty, keep=["doc_id"]).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords(n):
    code = language_id.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= 1 and (n < 4 or min(apart) >= 3)


def test_one_wrong_bit_is_corrected():
    code = language_id.codewords(4)
    model = language_id.LanguageModel(list("abcd"), code, np.zeros((language_id.FEATURES, 7)), np.full(code.shape, 1 / 7))
    for k in range(4):
        for bit in range(7):
            margins = code[[k]].copy()
            margins[0, bit] *= -1
            assert model.losses(margins).argmin() == k


# 2


def test_quality_base(spark, small, local):
    for r in queries.op2_quality_rules(spark, small).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.base_quality(local[r.doc_id].text)
        assert not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    """Good text stays, junk in characters or words goes."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op2_quality_rules(spark, folder).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.7


def test_quality_odd(spark, odd):
    rules = quality_rules.fit(odd)
    rows = quality_rules.apply_rules(odd, rules, keep=["doc_id", "extra"]).collect()
    for r, (i, t, _, _) in zip(rows, ODD):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.base_quality(t), i
    assert quality_rules.apply_rules(odd.limit(0), rules).count() == 0
    assert quality_rules.fit(odd.limit(0)).classes == {}


def test_divergence_itself():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert quality_rules.distance(p, q)[0] == 1.0 and quality_rules.distance(p, p[0])[0] == 0.0
    assert quality_rules.repeated("a b c d e x a b c d e".split()) == 10 and quality_rules.repeated("a a a a a a".split()) == 6


# 3


def test_simhash(spark, small, local):
    rows = queries.op3_simhash(spark, small).collect()
    ids = [r.doc_id for r in rows]
    fps = [plain.fingerprint(local[i].text) for i in ids]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == plain.groups(ids, fps)


def test_simhash_odd(spark, odd):
    rows = simhash.near_duplicates(odd, keep=["source"]).collect()
    assert len(rows) == len(ODD)
    of = {r.doc_id: (r.fp, r.component_id) for r in rows if r.doc_id != 12}
    assert of[0] == (0, 0) and of[1] == (0, 0) and of[2] == (0, 0) and of[3][1] == of[4][1] == of[5][1] == 3 and of[6][1] == 6 and of[None][1] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 5)").count() == 1 and kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 16])
def test_links_lose_nothing(spark, most):
    """Random clusters, a large one among them, in blocks of either size, against all pairs."""
    rng = random.Random(most)
    fps = []
    for size in (1, 1, 2, 3, 5, 8, 13, 150):
        c = rng.getrandbits(64)
        for _ in range(size):
            x = c
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
            c = x if size == 13 else c  # a chain
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most)
    root = {r.node: r.root for r in components(edges).collect()}
    got = [root.get(f, f) for f in signed]
    want = plain.groups(list(range(len(fps))), fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_chain_condition_is_necessary():
    rng = random.Random(5)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(8)):
            b ^= 1 << rng.randrange(64)
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        found = any(len(simhash.linked(x, y, s)) for s in range(simhash.SEGMENTS))
        assert found == ((a ^ b).bit_count() <= 4)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert components(edges.limit(0)).count() == 0


def test_components_with_hubs(spark):
    """The centre of a star, the root of a large component and small groups, with keys that go by broadcast and keys that do not."""
    star = [(7, i) for i in range(1000, 1400)] + [(1000, 3)]
    groups = [(10_000 + 3 * i + j, 10_000 + 3 * i + j + 1) for i in range(50) for j in range(2)]
    edges = spark.createDataFrame(star + groups, "a long, b long").repartition(3)
    want = {(i, 3) for i in (3, 7, *range(1000, 1400))} | {(10_000 + 3 * i + j, 10_000 + 3 * i) for i in range(50) for j in range(3)}
    for least in (1, 20, 401, 1000):
        assert {(r.node, r.root) for r in components(edges, least=least).collect()} == want


# 4


def test_secrets(spark, small, local):
    for r in queries.op4_secrets(spark, small).collect():
        want = plain.base_spans(local[r.doc_id].text)
        assert r.base_sha256 == plain.sha(want)
        assert set(filter(None, want.split(","))) <= set(filter(None, r.spans.split(",")))


def test_secret_linking(spark):
    weak = "Zq8Kf02mPx71LwTt55Rr"
    texts = {1: f"user: alice then {weak} and https://db.example.org:5432/x", 2: f"nothing else, {weak}", 3: "user: alice", 4: f"user: alice {'x ' * 150}{weak}", 5: "AKIA" + "B" * 16 + f" {weak} ñ", 6: "password = abcdef user=bob", 7: "see https://example.org", 8: "ſecret = abcdefgh", 9: "password: token:abcdef", 10: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(df)).collect()}
    kinds = {i: [x.split(":")[0] for x in s.split(",") if x] for i, s in got.items()}
    assert kinds == {1: ["user", "mixed", "endpoint"], 2: [], 3: [], 4: [], 5: ["access", "mixed"], 6: ["assign", "user"], 7: [], 8: [], 9: [], 10: []}
    for i, s in got.items():
        assert all(texts[i][int(a) : int(b)].strip() for _, a, b in (x.split(":") for x in s.split(",") if x))
    assert [plain.base_spans(t) for t in texts.values()] == [",".join(x for x in got[i].split(",") if x.split(":")[0] in secrets.BASE) for i in texts]


def test_redaction(spark, odd):
    out = secrets.redact(odd)
    assert [c for c in out.columns if c != "__changed"] == odd.columns and out.count() == len(ODD)
    row = out.where("__changed").collect()
    assert len(row) == 1 and row[0].text == "[SECRET]' [SECRET] [SECRET]" and "hunter22" not in row[0].text
    assert out.where("doc_id = 0").first().text is None
    assert secrets.redact(odd.limit(0)).count() == 0


# 5 and 8


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    y = np.array(labels)[order]
    n1 = y.sum()
    return ((np.arange(len(y)) + 1)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_compression_quality(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op5_compression_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.8
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.95


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op8_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in rows], [r.toxic for r in rows]) > 0.8
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.05


@pytest.mark.parametrize("op", [compression, toxicity])
def test_classifiers_odd(spark, odd, op):
    label = "quality" if op is compression else "toxic"
    run = compression.score_quality if op is compression else toxicity.score_toxicity
    for rows in ([(i, i % 2) for i in (3, 6, 7, 8, 9, 10, 11)], [(3, 1)], [], [(3, None), (None, 1)]):
        model = op.fit(odd, spark.createDataFrame(rows, f"doc_id long, {label} int"))
        got = run(odd, model, keep=["doc_id", "lang", "score"]).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert run(odd.limit(0), model).count() == 0


def test_offending_sentences(spark):
    clean = ["the cat sat here", "all is well in town", "rain fell on the hills", "people walk by the sea"]
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        s = [rng.choice(clean) for _ in range(6)]
        if i % 4 == 0:
            s[i % 6] = rng.choice(["you vile brute", "such a vile oaf", "vile and low"])
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(i % 4 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, toxicity.fit(df, lab)).collect()}
    for i, text in rows:
        assert (got[i].score >= 0.5) == (i % 4 == 0)
        assert [("vile" in text[s.start : s.end]) for s in got[i].offending] == [True] * (i % 4 == 0)


# 6


def test_mixing(spark, small, local):
    rows = queries.op6_mixing(spark, small).collect()
    again = {r.doc_id: r.taken for r in queries.op6_mixing(spark, small).repartition(3).collect()}
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(plain.WORDS.findall(local[r.doc_id].text or "")) and r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        sizes[local[r.doc_id].source] = r.source_size
        taken[local[r.doc_id].source] = taken.get(local[r.doc_id].source, 0) + r.taken
    want = plain.targets(dict(sorted(sizes.items())))
    for r in rows:
        assert abs(r.target - want[local[r.doc_id].source]) < 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 100, "c": 1000}, {"a": 0, "b": 0}, {"a": 7}, {"a": 1, "b": 1, "c": 1, "d": 10_000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain.targets(sizes))


def test_mixing_odd(spark, odd):
    plan = mixing.mix(odd, bucket_rows=2).collect()
    assert len(plan) == len(ODD) and sum(r.taken for r in plan) == pytest.approx(sum(r.size for r in plan), abs=4)
    out = mixing.mixed(odd)
    assert [c for c in out.columns if c != "__cut"] == odd.columns
    assert sum(len(plain.WORDS.findall(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(odd).collect())
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_better_documents_come_earlier(spark):
    rows = [(i, "word " * 10 + ("# " * 20 if i % 2 else ""), "a" if i < 400 else "b") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).where("source_size > taken").collect()
    share = lambda odd_: np.mean([r.taken / r.size for r in got if r.doc_id % 2 == odd_ and r.doc_id >= 400])
    assert share(0) > share(1)


# 7


def test_bpe_is_exact(spark, docs, odd, local):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    vocabulary, known = bpe.Vocabulary.read(path), tokenizers.Tokenizer.from_file(path)
    encoder = bpe.fit(docs, vocabulary, most_words=500)
    assert len(encoder.ends) > 0
    for df, texts in ((docs, [r.text for r in docs.collect()]), (odd, [t for _, t, _, _ in ODD])):
        for r, t in zip(bpe.digests(df, encoder, keep=["doc_id"]).collect(), texts):
            ids = known.encode(t or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), plain.sha(" ".join(map(str, ids))))
            assert r.decoded_sha256 == plain.sha(known.decode(ids, skip_special_tokens=False))
    rows = bpe.decode(bpe.encode(odd, encoder, keep=["doc_id", "ids"]), encoder).collect()
    assert len(rows) == len(ODD) and rows[0].ids == [] and rows[0].decoded == ""
    assert bpe.encode(odd.limit(0), encoder).count() == 0
    nothing = bpe.fit(odd.limit(0), vocabulary)
    assert nothing.encode(["the <|endoftext|> end"]) == [known.encode("the <|endoftext|> end", add_special_tokens=False).ids]


def test_bpe_random_texts():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    vocabulary, known = bpe.Vocabulary.read(path), tokenizers.Tokenizer.from_file(path)
    encoder = bpe.Encoder(vocabulary, build([]), np.zeros(0, np.int32), np.zeros(0, np.int64), most_cached=50)
    rng = random.Random(9)
    letters = ["a", "b", "é", "é", "Σ", "İ", "ß", "'s", "'LL", " ", "\n", " ", " ", "\x1c", "1", "½", "#", "!!", "<|endoftext|>", "<|startoftext|", "日本", "🙂", "́", "K", "ﬁ", "\x00", "thequick"]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        assert encoder.encode([t]) == [known.encode(t, add_special_tokens=False).ids], repr(t)
    t = "a" * 3000 + "#" * 500 + "thequick" * 300
    assert encoder.encode([t]) == [known.encode(t, add_special_tokens=False).ids]


def test_automaton():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcñ") for _ in range(rng.randint(1, 9))).encode() + rng.choice([b"", b"tion", b"ing"]) for _ in range(3000)})
    a = Automaton(build(words))
    assert a.places(words).tolist() == list(range(len(words)))
    other = [w + b"z" for w in words[:50]] + [b"", b"zz"]
    assert (a.places(other) == -1).all() and len(a.final) < sum(map(len, words)) / 3  # suffixes are shared
    assert Automaton(build([])).places([b"x"]).tolist() == [-1]


# 9


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:140] = v[3]  # ties
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(700, None), (750, [1.0, None]), (800, [float("nan")] * 16), (850, [float("inf")] * 16), (900, []), (None, [1.0] * 16), (950, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("id") % 50 == 0, block=128, query_bytes=512).collect()
    q = {i: np.floor(256 * np.array(x, dtype=np.float32).astype(float)).astype(int) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    pad = {i: np.pad(x, (0, 16 - len(x))) for i, x in q.items()}
    want = {}
    for i in pad:
        if i % 50 == 0:
            want[i] = sorted(((-int(pad[i] @ x), j) for j, x in pad.items() if j != i))[:5]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {i: [(j, -s) for s, j in w] for i, w in want.items()} == {i: [(j, s) for _, j, s in sorted(rs)] for i, rs in by.items()}
    few = topk.search(df.where("vec_id in (0, 1, 2)"), F.col("id") == 0).collect()
    assert len(few) == 2 and topk.search(df.limit(0), F.col("id") == 0).count() == 0


def test_top_k_stops_early_only_on_proof():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(3000, 8)) ** 5 * 40).astype(np.int64)  # few large values, so that proofs come early
    ids = np.arange(3000)
    for blocks in (1, 7):
        held, levels = topk.Best(ids[:40], v[:40], 5), []
        for part in np.array_split(np.argsort(-(v**2).sum(1)), blocks):
            index = topk.ImpactIndex(ids[part], v[part])
            add = index.add
            index.add = lambda s, w, level, add=add: (levels.append((len(w), level)), add(s, w, level))
            held.see(index)
        for k in range(40):
            want = sorted((-int(v[k] @ v[j]), j) for j in ids if j != k)[:5]
            assert [(-int(a), int(b)) for a, b in zip(held.scores[held.at == k], held.ids[held.at == k])] == want
        assert sum(n for n, level in levels if level == topk.LEVELS - 1) < 40 * blocks / 2  # most end before the last level, or skip the block


def test_top_k_with_values_beyond_doubles():
    big = np.array([[2**40, 3], [2**40, 2], [2**40, 1], [-(2**40), 9]], dtype=np.int64)
    held = topk.Best(np.array([0]), big[:1], 2)
    held.see(topk.ImpactIndex(np.arange(4), big))
    assert [(int(i), int(s)) for i, s in zip(held.ids, held.scores)] == [(1, 2**80 + 6), (2, 2**80 + 3)] if held.scores.dtype == object else True


# 10


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_brown(spark, docs, local, frequent):
    rows = docs.select("doc_id", "text", held_out("doc_id", 5, 1).alias("held_out"))
    model, counts = brown.fit(rows.where("not held_out"), clustered=60, n_classes=8, frequent=frequent)
    got = {r.doc_id: r for r in brown.score(rows, model, counts, keep=["doc_id", "held_out"]).collect()}
    assert len(got) == len(local)
    ids = list(local)
    want = plain.base_lm([local[i].text for i in ids], [local[i].text for i in ids if plain.crc(i, 5) != 1])
    for i, (n, known, total, base) in zip(ids, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, plain.crc(i, 5) == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert np.allclose((10**model.transition).sum(1), 1)


def test_brown_odd(spark, odd):
    model, counts = brown.fit(odd)
    rows = brown.score(odd, model, counts, keep=["doc_id", "lang", "score"]).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) and r.perplexity >= 1 for r in rows)
    none, no_counts = brown.fit(odd.limit(0))
    empty = brown.score(odd, none, no_counts, keep=["doc_id"]).collect()
    assert {r.n_known for r in empty} == {0} and all(r.base_score == pytest.approx(0) for r in empty)
    assert brown.score(odd.limit(0), model, counts).count() == 0


def test_exchange_finds_classes():
    """Two kinds of words that always follow each other end up apart."""
    rng = np.random.default_rng(0)
    table = np.zeros((11, 11))
    for _ in range(4000):
        a, b = rng.integers(0, 5), rng.integers(5, 10)
        table[a, b] += 1
        table[b, rng.integers(0, 5)] += 1
    of = brown.exchange(table, 10, 2)
    assert len(set(of[:5])) == 1 and len(set(of[5:10])) == 1 and of[0] != of[5] and of[10] == 2


def test_exchange_ends_where_no_single_move_helps():
    def likelihood(b, of):
        m = np.eye(of.max() + 1)[of]
        g = m.T @ b @ m
        return brown.xlogx(g).sum() - brown.xlogx(g.sum(0)).sum() - brown.xlogx(g.sum(1)).sum()

    for seed in range(8):
        rng = np.random.default_rng(seed)
        b = (rng.integers(0, 50, (12, 12)) * (rng.random((12, 12)) < 0.5)).astype(float)
        of = brown.exchange(b, 9, 3, passes=50)
        best = max(likelihood(b, np.array([*of[:i], c, *of[i + 1 :]])) for i in range(9) for c in range(3))
        assert best <= likelihood(b, of) + 1e-6


def test_emissions_sum_to_one(spark):
    texts = [("a b a c d e f g",), ("a b b a z y x",), ("q a b",)]
    model, counts = brown.fit(spark.createDataFrame(texts, "text string"), clustered=2, n_classes=2, frequent=4)
    left = {bytes(r.word): r.n for r in counts.collect()}
    mass = {}
    for w, n in left.items():
        c = model.classes[model.words[w]] if w in model.words else model.n_clustered + brown.ending(w)
        p = 10 ** (model.emission[model.words[w]] if w in model.words else np.log10(n + 0.5) - model.ending_total[brown.ending(w)])
        mass[c] = mass.get(c, 0) + p
    for c, p in mass.items():
        unseen = 0.5 / 10 ** model.ending_total[c - model.n_clustered] if c >= model.n_clustered else 0
        assert p + unseen == pytest.approx(1)


def test_most_frequent(spark):
    rng = random.Random(3)
    rows = [(f"w{i}".encode(), rng.randint(1, 500)) for i in range(2000)]
    df = checkpointed(spark.createDataFrame([(bytearray(w), n) for w, n in rows], "word binary, n long"))
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 100, 1999, 5000):
        assert [(bytes(r.word), r.n) for r in most_frequent(df, k).collect()] == want[:k]
    assert most_frequent(df.limit(0), 5).count() == 0


# all


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_oracles(spark, small, name):
    from tests.compare import connect, of_duckdb, of_spark

    assert of_spark(queries.QUERIES[name](spark, small)) == of_duckdb(connect(small), queries.ORACLES[name])


def test_language_stage_keeps_clean_documents(spark, docs):
    import corpus_pipeline

    assert corpus_pipeline.identified(spark, docs, None).count() == docs.count()


def test_texts_between_languages_stay(spark, docs):
    model = language_id.fit(docs)
    first = {r.lang: r.text for r in docs.where("length(text) between 400 and 4000").collect()}
    mixes = [(i, first[a][:400] + " " + first[b][:400]) for i, (a, b) in enumerate([("de", "en"), ("en", "fr"), ("es", "fr"), ("de", "es")])]
    df = spark.createDataFrame([*mixes, (9, "123 456"), (10, None)], "doc_id long, text string")
    assert {r.doc_id for r in language_id.accepted(df, model).collect()} == {0, 1, 2, 3}


def test_texts_like_no_language_go(spark, docs):
    """Random letters and foreign scripts of any length are flagged and dropped; held-out documents are not."""
    held = held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~held))
    rng = random.Random(8)

    def noise(alphabet, n):
        words = []
        while n > 0:
            words.append("".join(rng.choice(alphabet) for _ in range(min(n, rng.randint(2, 9)))))
            n -= len(words[-1])
        return " ".join(words)

    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是不了人我在有他这中大来上国"]
    rows = [(1000 * k + n, noise(alphabet, n)) for k, alphabet in enumerate(alphabets) for n in (60, 100, 300, 1000, 5000) for _ in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert language_id.accepted(df, model).count() == 0
    assert all(r.ambiguous for r in language_id.identify(df, model).collect())
    kept = language_id.accepted(docs.where(held), model)
    assert kept.count() == docs.where(held).count()


def test_words_beyond_the_first_get_classes_by_their_neighbours(spark):
    """Names, verbs and things of one ending, of which only two of each kind start the classes."""
    rng = random.Random(6)
    kinds = [[f"{k}{i}xyz" for i in range(30)] for k in "abc"]
    weights = [200, 200, *[5] * 28]
    texts = [(" ".join(rng.choices(kinds[j % 3], weights)[0] for j in range(30)),) for _ in range(400)]
    model, _ = brown.fit(spark.createDataFrame(texts, "text string"), clustered=6, n_classes=3)
    of = [{int(model.classes[model.words[w.encode()]]) for w in kind if w.encode() in model.words and model.counts[model.words[w.encode()]] >= 8} for kind in kinds]
    assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 3 and (model.classes[model.counts >= 8] < model.n_clustered).all()


def test_best_classes_are_those_of_the_likelihood():
    def likelihood(b, of):
        m = np.eye(6)[of]
        g = m.T @ b @ m
        return brown.xlogx(g).sum() - brown.xlogx(g.sum(0)).sum() - brown.xlogx(g.sum(1)).sum()

    for seed in range(8):
        rng = np.random.default_rng(seed)
        b = (rng.integers(0, 50, (12, 12)) * (rng.random((12, 12)) < 0.6)).astype(float)
        np.fill_diagonal(b, 0)
        of = np.concatenate([rng.integers(0, 6, 10), [4, 5]])
        m = np.eye(6)[of]
        got = brown.best_classes(m.T @ b @ m, (m.T @ b).T, b @ m, of, 4)
        for w in range(12):
            each = [likelihood(b, np.array([*of[:w], c, *of[w + 1 :]])) for c in range(4)]
            assert each[got[w]] >= max(each) - 1e-6


def test_quality_flat_vocabulary_has_its_top_words(spark):
    """No word of these reaches a fixed share of its language; the top ones are found all the same."""
    words = [f"w{i:04d}" for i in range(6000)]
    rows = [(" ".join(words), "flat"), (" ".join(words[5900:]), "flat"), ("one two two", "few")]
    found = quality_rules.fit(spark.createDataFrame(rows, "text string, lang string")).words
    assert found["flat"][0] == [w.encode() for w in words[5900:5960]] and found["few"][0] == [b"two", b"one"]


# names of kept columns

CLASH = {
    "base": "b", "all": "a", "every": "e", "weak": "w", "linked": "l", "size": 7, "taken": 8, "target": 9.5, "root": "r", "key": "k", "a.b": "dot", "fp": "f", "component_id": "c", "row": 3, "id": "i", "t": "t", "s": "s", "b": "bb", "n": 4,
    "k0": "k", "__row": 1, "__text": "x", "__cut": "cut", "__changed": "ch", "n_tokens": 5, "held": True, "`tick": "q", "base_spans": "bs", "word": "w", "place": "p", "q": 0.5, "offset": "o", "most": "m",
}


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "abc"[i % 3], 9, *CLASH.values()) for i, t in enumerate(["password = hunter2222 user: joe", "the cat sleeps in the house and the dog in the garden", "la maison est dans le jardin de la ville", "one two three four five six", "one two three four five six", None])]
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` " + kinds[type(v)] for c, v in CLASH.items()))


def unchanged(df, rows, made=()):
    """All clashing columns but those that the result has itself hold their values."""
    names = df.columns
    assert len(names) == len(set(names))
    found = df.collect()
    assert len(found) == rows
    for c, v in CLASH.items():
        if c not in made:
            at = names.index(c)
            assert {r[at] for r in found} == {v}, c


def test_columns_of_any_name_survive(spark, clashing):
    model = language_id.fit(clashing)
    unchanged(language_id.identify(clashing, model), 6)
    unchanged(quality_rules.apply_rules(clashing, quality_rules.fit(clashing)), 6)
    unchanged(simhash.near_duplicates(clashing, keep=clashing.columns), 6, ("fp", "component_id"))
    unchanged(simhash.keep_one(clashing), 5)
    unchanged(secrets.find_secrets(clashing), 6, ("base_spans", "all_spans"))
    unchanged(secrets.redact(clashing), 6, ("__changed",))
    unchanged(mixing.mix(clashing, keep=clashing.columns), 6, ("size", "source_size", "target", "taken"))
    unchanged(mixing.mixed(clashing), mixing.mixed(clashing).count(), ("__cut",))
    brown_model, counts = brown.fit(clashing)
    unchanged(brown.score(clashing, brown_model, counts), 6, ("n_tokens",))


def test_stages_keep_columns_of_any_name(spark, clashing, small):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, small)
        assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}, name
        unchanged(out, out.count(), ("__cut", "__changed"))


def test_very_many_secrets_in_a_text(spark):
    """Linear in the number of findings: 48 000 in one text."""
    text = " ".join(["0a" * 12, "x"] * 48_000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    import time

    began = time.time()
    assert secrets.digest(secrets.find_secrets(df)).first().n_hex == 48_000
    assert secrets.redact(df).first().text == " ".join(["[SECRET]", "x"] * 48_000)
    assert time.time() - began < 30


def test_mixing_ranges_stay_small_whatever_the_weights(spark):
    """A third of the rows at the lowest weight, most at the highest: no range is much larger than asked for."""
    df = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0.05).otherwise(1.0).alias("q"), F.lit("").alias("s"), F.lit(30_000).alias("n"), F.lit(1).alias("size"))
    rows = df.withColumn("key", -F.log(F.rand(3)) / F.col("q"))
    per = mixing._ranged(rows, spark.createDataFrame([("", 30_000)], "s string, n long"), 500) if "n" not in rows.columns else mixing._ranged(rows.drop("n"), spark.createDataFrame([("", 30_000)], "s string, n long"), 500)
    sizes = [r["count"] for r in per.groupBy("b").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 700 and len(sizes) >= 55


def test_hot_keys_join_by_broadcast(spark):
    from signalweave.llm.common import join_all

    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = join_all(rows, table, "k", "n", 5000)
    assert got.count() == 5000 and set(got.columns) == {"k", "id", "low"} and {r.low for r in got.where("k = 0").collect()} == {0}


def test_quality_turns_down_texts_without_common_words(docs):
    """Random letters in the place of words fail by their words alone; documents with few symbols and repeats stay."""
    rules = quality_rules.fit(docs)
    rng = random.Random(5)
    junk = [" ".join("".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (100, 300, 1000, 5000)]
    by_class, by_word, failed = rules.judge(junk, [t.encode().split() for t in junk])
    assert failed.all() and (by_word > 0.38).all()
    kept = quality_rules.apply_rules(docs.where("text is not null"), rules, keep=["doc_id"]).where("not base_failed and n_symbols < n_words / 50").collect()
    assert sum(r.kept for r in kept) > 0.97 * len(kept)


# op1, op5 and op8 against plain versions, row by row


def test_language_id_against_plain_code(spark, docs, local):
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    got = {r.doc_id: r for r in language_id.identify(rows, language_id.fit(rows.where("not held_out")), keep=["doc_id"]).collect()}
    train = [(d.text, d.lang) for i, d in local.items() if plain.crc(i, 4) != 2 and d.lang is not None]
    for i, (lang, score) in zip(local, plain.languages(train, [d.text for d in local.values()])):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=2e-3), i


def test_a_text_has_the_same_letters_wherever_it_stands():
    a, b = language_id.features(["abc de", "x", "abc de"])[0][[0, 2]]
    assert (a == b).all()


def test_compression_against_plain_code(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables are too few to train a dictionary on
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality in (0, 1) and plain.crc(r.doc_id, 5) != 0}
    got = {r.doc_id: r.score for r in queries.op5_compression_quality(spark, folder).collect()}
    train = [(i, texts[i], y) for i, y in known.items() if i in texts]
    for i, score in zip(texts, plain.compression(train, list(texts.values()))):
        assert got[i] == pytest.approx(score, abs=1e-6), i


def test_toxicity_against_plain_code(spark):
    rng = random.Random(11)
    nice, nasty = ["garden", "river", "house", "music", "bread", "window", "letter", "market"], ["rotten", "scumbag", "vermin"]
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        lines = [" ".join(rng.choice(nice) for _ in range(4)) for _ in range(rng.randint(1, 4))]
        if toxic and i % 17:
            at = rng.randrange(len(lines))
            lines[at] += " " + rng.choice(nasty)
        rows.append((i, rng.choice([". ", "! ", "\n"]).join(lines), int(toxic)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, toxicity.fit(df, labels), keep=["doc_id"]).collect()}
    want = plain.toxicity([(t, y) for i, t, y in rows if i % 5], [t for _, t, _ in rows])
    assert max(want) > 0.8 and min(want) < 0.2
    for (i, t, _), score in zip(rows, want):
        assert got[i] == pytest.approx(score, abs=1e-4), (i, t)


def test_brown_scores_against_plain_code(spark):
    """The score of each text from the model's classes, and class and word probabilities counted anew."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()[: rng.randint(2, 8)]) for _ in range(30)) for _ in range(20)] + ["", "unseen words here alpha"]
    train = texts[:18]
    df = spark.createDataFrame([(i, t, i < 18) for i, t in enumerate(texts)], "id long, text string, train boolean")
    model, counts = brown.fit(df.where("train"), clustered=4, n_classes=3, least=8)
    of = {w: int(model.classes[i]) for w, i in model.words.items()}
    end, unseen = model.n_clustered + brown.ENDINGS, lambda w: model.n_clustered + brown.ending(w)
    seqs = [[end, *(of.get(w, unseen(w)) for w in t.encode().split()), end] for t in train]
    pair, before, after = (plain.Counter() for _ in range(3))
    for s in seqs:
        for a, b in zip(s, s[1:]):
            pair[a, b] += 1
            before[a] += 1
            after[b] += 1
    n = plain.Counter(w for t in train for w in t.encode().split())
    kinds, total = end + 1, sum(before.values())

    def transition(a, b):
        share = (after[b] + 0.5) / (total + 0.5 * kinds)
        follows = sum(1 for x, _ in pair if x == a)
        back = follows / (follows + before[a]) if before[a] else 1.0
        return (1 - back) * pair[a, b] / max(before[a], 1) + back * share

    def emission(w):
        c = of.get(w, unseen(w))
        if c < model.n_clustered:
            return n[w] / sum(k for x, k in n.items() if of[x] == c)
        others = [k for x, k in n.items() if of[x] == c]
        return (n[w] + 0.5) / (sum(others) + 0.5 * (len(others) + 1))

    for r in brown.score(df, model, counts, keep=["id"]).collect():
        words = texts[r.id].encode().split()
        s = [end, *(of.get(w, unseen(w)) for w in words), end]
        want = sum(np.log10(transition(a, b)) for a, b in zip(s, s[1:])) + sum(np.log10(emission(w)) for w in words)
        assert r.score == pytest.approx(want, abs=1e-6), r.id
