"""MinHash near-duplicates, lexical search and spelling variants against plain versions, with odd inputs and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import lexical, minhash, queries, spelling

from . import plain
from .test_llm_operators import LONG, ODD, SCHEMA, odd  # noqa: F401

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def check_minhash(df, rows, **more):
    found = minhash.near_duplicates(df, **more).collect()
    sizes, roots = plain.jaccard_groups([i for i, _ in rows], [t for _, t in rows])
    none = lambda x: (x is None, x)
    key = lambda r: tuple(map(none, r))
    want = sorted(((i, n, g, i is not None and i == g) for (i, _), n, g in zip(rows, sizes, roots)), key=key)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=key) == want
    return want


def test_minhash(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    sizes, roots = plain.jaccard_groups([r.doc_id for r in docs], [r.text for r in docs])
    want = {(r.doc_id, n, g, r.doc_id == g) for r, n, g in zip(docs, sizes, roots)}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op11_minhash(spark, small).collect()} == want
    assert any(r[0] != r[2] for r in want)


def test_minhash_odd(spark, odd):  # noqa: F811
    check_minhash(odd, [(i, t) for i, t, _, _ in ODD])
    kept = minhash.near_duplicates(odd.withColumn("n", F.lit(7)).withColumn("a.b", F.lit(3)), keep=["n", "a.b", "kept", "score"])
    assert kept.columns == ["doc_id", "n", "a.b", "score", "n_shingles", "component_id", "kept"] and {r["n"] for r in kept.collect()} == {7}
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    assert minhash.near_duplicates(odd.where("doc_id is null")).collect()[0].kept is False


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return words


@pytest.mark.parametrize("most", [2048, 16])
def test_minhash_groups_that_fall_apart(spark, most):
    """Families about the limit: chains, members that are near some and not others, in blocks smaller than a family."""
    rows = []
    for family in range(6):
        base = [RNG.choice(WORDS) for _ in range(120)]
        at = base
        for i in range(40):
            at = edited(base if i % 3 else at, RNG.choice([1, 2, 3, 4]))
            rows.append((len(rows) * 7 % 1000 + family * 1000, " ".join(at)))
    rows += [(90_000 + i, "same words here") for i in range(50)]
    check_minhash(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, most=most)


def test_chunk_keys_meet_within_the_distance(spark):
    """Whatever 19 symbols differ, two signatures have a key in common."""
    for _ in range(200):
        a = np.array([RNG.randrange(2**16) for _ in range(minhash.SYMBOLS)], dtype=np.uint16)
        b = a.copy()
        for i in RNG.sample(range(minhash.SYMBOLS), minhash.ERRORS):
            b[i] ^= 1
        chunks = (a != b).reshape(minhash.CHUNKS, minhash.WIDTH).sum(1)
        assert chunks.min() <= 1
    rows = spark.createDataFrame([(0, bytes(a.tobytes())), (1, bytes(b.tobytes()))], "u long, sig binary")
    keys = [{r.k for r in minhash.chunk_keys(rows).collect() if r.u == u} for u in (0, 1)]
    assert len(keys[0]) == 40 and keys[0] & keys[1]


# 12


def check_ranked(found, docs, items):
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()) == sorted(plain.ranked(docs, items))


def test_lexical_search(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    check_ranked(queries.op12_lexical_search(spark, small), [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize(("block", "item_bytes"), [(16384, 4 << 20), (7, 200)])
def test_lexical_search_odd(spark, odd, block, item_bytes):  # noqa: F811
    """Ties, repeated terms, items in several passes, blocks of few documents."""
    items = [(1, "The HOUSE the house garden"), (2, None), (3, ""), (4, "one"), (5, "nowhere-to-be-found"), (6, "la maison; końiec 12345"), (7, "x" * 300), (8, "word another id b c 🙂🙂 d")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items] + [(4, "one", 2)], "item_id int, text string, doc_id int")
    check_ranked(lexical.search(odd, asked, block=block, item_bytes=item_bytes), [(i, t) for i, t, _, _ in ODD], items)
    assert lexical.search(odd.limit(0), asked).count() == 0
    assert lexical.search(odd, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_stop():
    """Once the remaining terms cannot reach the k-th best, no document gets an accumulator; those that have one are exact."""
    n = 5000
    ids, lengths = np.arange(n), np.full(n, 10)
    terms = np.concatenate([[0, 1] if i < 20 else [1] for i in range(n)])
    offsets = np.append(0, np.cumsum([2 if i < 20 else 1 for i in range(n)]))
    index = lexical.Block(ids, lengths, offsets, terms, np.ones(len(terms), np.int64), np.array([5000, 3]), n, n * 10)
    found, scores = index.search(np.array([0, 1]), np.array([1, 1]), 10, 0)
    assert sorted(found) == list(range(20)) and set(scores) == {index.largest.sum()}
    assert len(index.search(np.array([0, 1]), np.array([1, 1]), 10, int(index.largest.sum()) + 1)[0]) == 0


# 13


def check_spelling(found, docs):
    rows = found.collect()
    want = plain.spelling(docs)
    assert len(rows) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want
    return want


@pytest.mark.parametrize("folder", ["small", "/root/testdata/sf0.01"])
def test_spelling_variants(spark, request, folder):
    folder = request.getfixturevalue("small") if folder == "small" else folder
    want = check_spelling(queries.op13_spelling_variants(spark, folder), [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
    assert any(f for f, *_ in want.values())


def test_spelling_odd(spark, odd):  # noqa: F811
    rows = [(i, t) for i, t, _, _ in ODD] + [(20, "abcdefg abcdefg " * 5 + "abcdefgh " * 60 + "abcdefghi " * 700 + "ÀÉîöüÿß àéîöüÿß Éabcdefg Éabcdefg"), (21, "z" * 90 + " " + "z" * 91 + " " + "z" * 45 + "y" + "z" * 45), (21, "z" * 90 + " " + "z" * 91 + " " + "z" * 45 + "y" + "z" * 45)]
    df = spark.createDataFrame([(i, t, None, None, 1, 1.0, "n", [1]) for i, t in rows], SCHEMA)
    want = check_spelling(spelling.variants(df), rows)
    assert want["z" * 90][3] == 2
    assert spelling.variants(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 5])
def test_spelling_blocks(spark, most):
    """Dense neighbourhoods and long words, in blocks smaller than a group."""
    words = {"".join(RNG.choice("ab") for _ in range(RNG.choice([8, 9, 10]))): RNG.randrange(2, 500) for _ in range(300)}
    words |= {"e" * 50 + x: 5 for x in ("", "a", "b", "ab", "abc")}
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), most)
    want = {}
    for a in words:
        near = [b for b in words if spelling.one_edit(a.encode(), b.encode())]
        if near:
            best = min(near, key=lambda b: (-words[b], b))
            want[a] = (len(near), best, words[best])
    assert {r.word: (r.n_near, r.near, r.near_n) for r in found.collect()} == want


def test_one_edit():
    near = [(b"abcdefg", b"abcdefh"), (b"abcdefg", b"abcdefgh"), (b"abcdefg", b"xabcdefg"), (b"aaaaaaa", b"aaaaaaaa"), (b"abcdefg", b"abxcdefg")]
    far = [(b"abcdefg", b"abcdegf"), (b"abcdefg", b"abcdefg"), (b"abcdefg", b"xbcdefx"), (b"abcdefg", b"abcdefghi")]
    assert all(spelling.one_edit(a, b) and spelling.one_edit(b, a) for a, b in near) and not any(spelling.one_edit(a, b) for a, b in far)
