"""The five stages, each on what the one before it kept."""

import corpus_pipeline
from signalweave.llm import bpe, queries

from . import plain

ORDER = ["language_id", "simhash", "secrets", "mixing", "bpe"]


def test_stages(spark, small, tmp_path):
    tokenizer = bpe.Vocabulary.read(queries.vocabulary_path())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == names
    assert list(seen) == ORDER
    kept = seen["language_id"]
    want = plain.groups([r.doc_id for r in kept], [plain.fingerprint(r.text) for r in kept])
    assert sorted(r.doc_id for r in seen["simhash"]) == sorted(set(want))
    before, after = {r.doc_id: r for r in seen["simhash"]}, {r.doc_id: r for r in seen["secrets"]}
    assert set(before) == set(after)
    for i, r in after.items():
        assert (r.text == before[i].text) == (not plain.base_spans(before[i].text))
        assert r.text == before[i].text or (not plain.base_spans(r.text) and r.n_chars == len(r.text))
    sizes = {}
    for r in seen["secrets"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.WORDS.findall(r.text))
    taken = {s: 0 for s in sizes}
    for r in seen["mixing"]:
        taken[r.source] += len(plain.WORDS.findall(r.text))
        assert after[r.doc_id].text.startswith(r.text)
    target = plain.targets(dict(sorted(sizes.items())))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert len(seen["bpe"]) == len(seen["mixing"])
    mixed = sorted((r.doc_id, len(r.text), r.text) for r in seen["mixing"])
    words = bpe.Encoder(tokenizer, bpe.build([]), bpe.np.zeros(0, int), bpe.np.zeros(0, int))
    assert sorted((i, ids) for (i, _, _), ids in zip(mixed, words.encode([t for _, _, t in mixed]))) == sorted((r.doc_id, r.ids) for r in seen["bpe"])


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0 and corpus_pipeline.ORACLE_SQL is None
