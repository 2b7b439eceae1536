"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, brown, compression, language_id, lexical, minhash, mixing, oracles, quality_rules, secrets, simhash, spelling, topk, toxicity
from .common import held_out, table


def vocabulary_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs, model, keep=["doc_id", "held_out"])


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.apply_rules(docs, quality_rules.fit(docs), keep=["doc_id"])
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs, keep=["doc_id"]))


def _labels(spark, sf_dir):
    """The labels that op5 and op8 may learn from."""
    return table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))


def op5_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    model = compression.fit(docs.where("not held_out"), _labels(spark, sf_dir))
    scored = compression.score_quality(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_bpe(spark, sf_dir, vocabulary=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = bpe.fit(docs, bpe.Vocabulary.read(vocabulary or vocabulary_path()))
    return bpe.digests(docs, encoder, keep=["doc_id"])


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    model = toxicity.fit(docs.where("not held_out"), _labels(spark, sf_dir))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_top_vectors(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op10_brown_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 1).alias("held_out"))
    model, counts = brown.fit(docs.where("not held_out"))
    return brown.score(docs, model, counts, keep=["doc_id", "held_out"])


def op11_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_simhash, op4_secrets, op5_compression_quality, op6_mixing, op7_bpe, op8_toxicity, op9_top_vectors, op10_brown_lm, op11_minhash, op12_lexical_search, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op2_quality_rules": oracles.QUALITY, "op4_secrets": oracles.SECRETS, "op6_mixing": oracles.MIXING, "op9_top_vectors": oracles.TOP_VECTORS, "op11_minhash": oracles.MINHASH, "op12_lexical_search": oracles.LEXICAL, "op13_spelling_variants": oracles.SPELLING}
