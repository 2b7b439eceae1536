"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source gets a target of words: its weight's share of all words, but at most ``cap`` times its own
words, the excess going to the others by weight. A target is met by complete epochs of the source first; the
rest comes from its documents in the order of exponential keys, -ln(u) / quality weight with u from a
hash of the id, so that a better document tends to come earlier. The last document is cut where the budget ends.

No source is sorted in one task: documents fall into key ranges of about ``bucket_rows`` rows, cut by the source's own weights, a
running sum goes over ranges in groups of 1024, and only rows of one range are sorted together.

Cases: null texts have size 0 and take nothing; null sources are one source, last in the order; equal keys go by
id, then by the row's place. A total of 0 gives targets of 0. A null id takes its key from the row's place. Very
long texts are cut like others; an empty table gives no rows. Kept columns may have
any name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, join_all, quoted, renamed, restored, uniform

WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def symbol_weight(text: str = "text") -> Column:
    """A plain quality weight from 0.05 to 1: less for texts with many symbols."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), 1.0 - 5.0 * symbols / F.greatest(F.length(t), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """sizes: one row a source (source, source_size, ...); adds ``target``. Weights repeat over sources by code point, null last.

    With sources by the weight at which each would reach its cap, those before the first that stays under it are
    at their caps and share nothing further. The windows run over one row a source.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    before, everyone = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level")))).over(everyone)["level"]
    return rows.withColumn("target", F.when(final.isNull(), F.col("most")).otherwise(F.least("most", final * F.col("w")))).drop("w", "most", "level")


def _ranged(rows: DataFrame, by_source: DataFrame, bucket_rows: int) -> DataFrame:
    """The rows with the range ``b`` of their key, of about ``bucket_rows`` rows each, and their source's figures.

    A document of weight w has a key under x with probability 1 - exp(-w * x), so the mix of these over the source's own weights,
    taken in steps of a thirty-second of a doubling, tells the share of the source's rows before a key, whatever its weights are.
    """
    step = F.round(F.log2("q") * 32).cast("int")
    steps = rows.groupBy("s", step.alias("step")).agg(F.count("*").alias("rows"), F.avg("q").alias("q"))
    weights = steps.groupBy("s").agg(F.collect_list(F.struct("rows", "q")).alias("weights"))
    share = F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x["rows"] * (1.0 - F.exp(-x["q"] * F.col("key")))) / F.col("n")
    last = F.ceil(F.col("n") / bucket_rows) - 1
    table = checkpointed(by_source.join(weights, "s").withColumn("of_source", F.col("n")))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a source may be most of the rows; each has at most 139 steps of weights of 16 bytes, so 5000 of them are some 12 MB
    joined = join_all(rows, table, "s", "of_source", total, keys=5_000)
    return joined.withColumn("b", F.least(F.floor((last + 1) * share), last).cast("long")).drop("weights")


def _planned(docs: DataFrame, text: str, source: str, doc_id: str, quality: Column | None, cap: float, bucket_rows: int, keep: list[str]) -> DataFrame:
    """(id, size, source_size, target, taken) with the kept columns as ``renamed``."""
    quality = symbol_weight(quoted(text)) if quality is None else quality
    rows = renamed(docs, keep, id=F.col(quoted(doc_id)), source=F.col(quoted(source)), size=n_words(quoted(text)), q=quality, place=F.monotonically_increasing_id())
    u = F.coalesce(uniform("id", "mix"), uniform("place", "no id"))
    rows = checkpointed(rows.withColumn("key", -F.log(1.0 - u) / F.col("q")).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    by_source = targets(rows.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), cap=cap)
    ranged = checkpointed(_ranged(rows.drop("source"), checkpointed(by_source.drop("source")), bucket_rows))
    inside = Window.partitionBy("s", "b").orderBy("key", F.asc_nulls_last("id"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # words before each range: those of the groups of ranges before it, and those before it in its group
    group = F.floor(F.col("b") / 1024).alias("g")
    words = ranged.groupBy("s", "b", group).agg(F.sum("size").alias("words"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = words.groupBy("s", "g").agg(F.sum("words").alias("all_words")).select("s", "g", F.coalesce(F.sum("all_words").over(before("s", "g")), F.lit(0)).alias("earlier"))
    offsets = words.withColumn("own", F.coalesce(F.sum("words").over(before("s", "g", "b")), F.lit(0))).join(groups, ["s", "g"]).select("s", "b", (F.col("own") + F.col("earlier")).alias("offset"))
    upto = ranged.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["s", "b"])
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("upto") - F.col("size"))))
    return upto.withColumn("taken", (F.col("size") * epochs + part).cast("long")).select("id", "size", "source_size", "target", "taken", *[f"k{i}" for i in range(len(keep))])


MADE = ["doc_id", "size", "source_size", "target", "taken"]


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", quality: Column | None = None, cap: float = 3.0, bucket_rows: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """The id (as doc_id) and kept columns with size, source_size, target and taken of each row; a kept column of one of these names is dropped."""
    keep = [c for c in keep or [] if c not in MADE]
    return _planned(docs, text, source, doc_id, quality, cap, bucket_rows, keep).select(F.col("id").alias("doc_id"), *MADE[1:], *restored(keep))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", quality: Column | None = None, cap: float = 3.0, bucket_rows: int = 1024) -> DataFrame:
    """The rows themselves, once for each complete epoch, and once more, perhaps cut, for what is taken of the next.

    Cutting keeps the white space: it takes words and what stands before each. A column ``__cut`` tells cut copies; an input column of
    that name is dropped in its favour. Rows are numbered once, in a checkpoint.
    """
    keep = [c for c in docs.columns if c != "__cut"]
    q = symbol_weight(quoted(text)) if quality is None else quality
    numbered = checkpointed(renamed(docs, keep, row=F.monotonically_increasing_id(), q=q))
    at = {c: f"k{i}" for i, c in enumerate(keep)}
    plan = _planned(numbered, at[text], at[source], at[doc_id], F.col("q"), cap, bucket_rows, ["row"]).where("taken > 0").select(F.col("k0").alias("row"), "size", "taken")
    t = F.col(at[text])
    pieces = F.zip_with(F.slice(F.split(t, WORD, -1), 1, F.col("n")), F.slice(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), 1, F.col("n")), lambda gap, word: F.concat(gap, word))
    rows = numbered.join(plan, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rows = rows.withColumn("n", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int"))
    cut = F.when(F.col("n") == F.col("size"), t).otherwise(F.array_join(pieces, ""))
    return rows.select(*[(cut if c == text else F.col(at[c])).alias(c) for c in keep], (F.col("n") < F.col("size")).alias("__cut"))
