"""A training corpus in five stages: language ID, near-duplicates, secrets, mixing, encoding.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from signalweave.llm import bpe, language_id, mixing, secrets, simhash
from signalweave.llm.common import checkpointed, quoted
from signalweave.llm.queries import vocabulary_path


def _counted(changed, rows):
    """n_chars follows the text where the stage has changed it, if there is such a column."""
    names = [c for c in rows.columns if c != changed]
    counted = {}
    if "n_chars" in names:
        counted["n_chars"] = F.when(F.col(changed), F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*[counted.get(c, F.col(quoted(c))) for c in names])


def identified(spark, docs, sf_dir):
    """Drops documents without letters, or whose language stays unclear in spite of enough letters."""
    return language_id.accepted(docs, language_id.fit(docs))


def deduplicated(spark, docs, sf_dir):
    """Keeps one document, the one with the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_secrets(spark, docs, sf_dir):
    """Puts a mark in place of each secret, strong or linked; keeps all documents."""
    return _counted("__changed", secrets.redact(docs))


def mixed(spark, docs, sf_dir):
    """Gives each source its target of words: documents once for each epoch, those that are not taken go.

    Where a source's budget ends within a document, that copy of it ends there too.
    """
    return _counted("__cut", mixing.mixed(docs))


def encoded(spark, docs, sf_dir):
    """doc_id, source, n_tokens and ids of each document."""
    encoder = bpe.fit(docs, bpe.Vocabulary.read(vocabulary_path()))
    return bpe.encode(docs, encoder, keep=["doc_id", "source"]).withColumn("n_tokens", F.size("ids"))


STAGES = [("language_id", identified), ("simhash", deduplicated), ("secrets", without_secrets), ("mixing", mixed), ("bpe", encoded)]
#: SQL has no way to say what the language model, fingerprints by majority, or merges do; tests hold it against plain code.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over all of ``documents``, each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
