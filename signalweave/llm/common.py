"""Helpers that the operators share: reading tables, batches of texts, checkpoints.

The code that runs in Python workers is imported there by name, so the package has to be on the
executors' PYTHONPATH (``--py-files`` or an installed wheel).
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to numpy in slices of about so many characters, however long one text is.
SLICE_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of an id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % n


def held_out(col: str, n: int, value: int):
    """True on the rows that no model learns from. A null id is neither held out nor learnt from."""
    return F.coalesce(crc_mod(col, n) == value, F.lit(False))


def uniform(col, salt: str):
    """A number in [0, 1) that depends on the id alone, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(col).cast("string"), F.lit(salt))), 1, 12), 16, 10).cast("double") / float(16**12)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's shared checkpoint folder; survives the loss of executors.

    Only a local session that names no folder gets one made for it; a cluster has to name a folder that all its machines share.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="signalweave-"))
    return df.checkpoint(eager=True)


def renamed(df: DataFrame, keep: list[str], **more) -> DataFrame:
    """The columns ``keep`` as k0, k1, ... with those of ``more``, so that no name of a working column can meet a kept one, whatever it is."""
    return df.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], *[x.alias(n) for n, x in more.items()])


def restored(keep: list[str]) -> list:
    """The columns of ``renamed`` under their own names again."""
    return [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]


def quoted(name: str) -> str:
    """A column's name so that dots and backticks in it are part of it."""
    return "`" + name.replace("`", "``") + "`"


def join_all(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, least: int = 1000, keys: int = 1_000_000) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in ``n`` how many of the ``total`` rows have it.

    Keys of over ``least`` rows, and over total / ``keys``, are joined by a broadcast, so that no key fills a task; as they are at most
    ``keys`` keys, its size is bounded. All others meet by a shuffle.
    """
    hot = F.col(n) > max(least, total // keys)
    few, many = F.broadcast(table.where(hot).drop(n)), table.where(~hot).drop(n)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(many, key))


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of at most ``limit`` characters, or one longer text alone."""
    at = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > limit:
            yield at, i
            at, chars = i, 0
        chars += len(t)
    if at < len(texts):
        yield at, len(texts)


def map_texts(df: DataFrame, text: str, out: T.StructType, fn: Callable[[list], list], keep: list[str], as_bytes: bool = False) -> DataFrame:
    """The columns ``keep`` of ``df`` with those that ``fn`` makes of each text; null texts are empty.

    ``fn`` takes a list of texts (str, or UTF-8 bytes) and returns one list or array for each field of ``out``.
    A kept column whose name ``out`` also has is dropped in its favour.
    """
    keep = [c for c in keep if c not in out.names]
    source = renamed(df, keep, text=F.coalesce(F.col(quoted(text)), F.lit("")))
    schema = T.StructType(source.schema.fields[:-1] + out.fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.num_columns - 1)
            texts = (column.cast(pa.binary()) if as_bytes else column).to_pylist()
            for a, b in slices(texts):
                made = fn(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)] + [pa.array(x, type=f.type) for x, f in zip(made, arrow)],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema).select(*restored(keep), *out.names)


def count_words(df: DataFrame, text: str, lower: bool = True, group: str | None = None, most: int = 400_000) -> DataFrame:
    """Words of all texts with their numbers: [group,] word binary, n long.

    Each task counts before the shuffle and hands on its counts whenever it holds ``most`` words.
    """
    source = df.select(F.coalesce(F.col(quoted(group)), F.lit("")).alias("g") if group else F.lit("").alias("g"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("t"))

    def run(batches):
        counts: dict[str, Counter] = {}

        def out():
            for g, c in counts.items():
                words, ns = list(c), list(c.values())
                for i in range(0, len(words), 50_000):
                    k = len(words[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([g] * k, pa.string()), pa.array(words[i : i + 50_000], pa.binary()), pa.array(ns[i : i + 50_000], pa.int64())], names=["g", "word", "n"])
            counts.clear()

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts.setdefault(g, Counter()).update((t.lower() if lower else t).split())
                if len(t) > 1 and sum(map(len, counts.values())) > most:
                    yield from out()
        yield from out()

    found = source.mapInArrow(run, "g string, word binary, n long").groupBy("g", "word").agg(F.sum("n").alias("n"))
    return found.withColumnRenamed("g", group) if group else found.drop("g")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, per_class: int, salt: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows (y, t) of about ``per_class`` documents of label 0 and of 1 (all, if fewer), and the numbers of both labels.

    The sample is picked by a hash of the ids among the labels alone. It is broadcast, at most 4 * per_class
    rows of two numbers, so that no other text leaves its scan, and the texts found are checkpointed.
    """
    known = labels.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(label)).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    # in the order of the hash, so that the sample is the same however the labels are dealt
    picked = F.broadcast(known.where(uniform("i", salt) < share).orderBy(uniform("i", salt), "i", "y").limit(4 * per_class))
    sample = docs.select(F.col(quoted(doc_id)).alias("i"), F.col(quoted(text)).alias("t")).where("t is not null").join(picked, "i")
    return checkpointed(sample.select("y", "t", uniform("i", salt + " order").alias("u"))), counts


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent words of (word, n), ties by the smaller word.

    A histogram of the numbers, in steps of an eighth of a doubling, tells how frequent a word has to be, so only about k
    rows are sorted and not k of each partition. ``counts`` is read twice.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    floor, total = 0, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("words")).collect(), reverse=True):
        floor, total = r.s, total + r.words
        if total >= k:
            break
    return counts.where(step >= floor).orderBy(F.desc("n"), "word").limit(k)
