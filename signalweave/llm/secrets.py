"""Secrets in texts, with multipart credential linking, in DataFrame functions only.

Strong findings count alone: labelled values, access identifiers, long hexadecimal runs. Weak ones are what is
often harmless: a random-looking string, a user label, an endpoint. A weak finding is only
reported when parts that complete it lie within its scope (``SCOPE`` code points before or after):

- ``mixed`` (a random-looking string) with an identifier: an access identifier or a user label;
- ``user`` (a labelled account name) with a secret: a labelled value, a hexadecimal run or a mixed string;
- ``endpoint`` (a URL's scheme, host and port) with both an identifier and a secret.

The interval join is an equi-join on row and stretch of ``SCOPE`` code points against one summary a stretch
and role (first start, last end). As a stretch is no longer than twice the scope, that summary decides
exactly whether any part is within reach, and no pairs are made however many parts stand close together.

Cases: a null text counts as empty; without findings the spans are empty strings. Equal spans of several kinds are
all reported. Rows are told apart by their place, so null and repeated ids are no matter. An empty table gives no rows. Texts of any length
are searched whole, at a cost that grows with their length and their findings. Kept columns may have any name, also one with
a dot or that of a working column; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, renamed, restored

SCOPE = 200
#: Kinds in the order in which findings with one start are listed, with the regular expression of each.
#: Letters of labels are spelt in both cases so that only ASCII letters match.
KINDS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "mixed": "[A-Za-z0-9+/_-]{16,}",
    "user": r"""([Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""",
    "endpoint": r"[A-Za-z][A-Za-z0-9+]*://[A-Za-z0-9.-]+(:[0-9]+)?",
}
BASE, WEAK = ["assign", "access", "hex"], ["mixed", "user", "endpoint"]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "mixed": "secret", "user": "identifier", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running(items: Column, amount, combine, zero: Column, step, out: str, chunk: int = 256, shared=None) -> Column:
    """``step`` over items in order with a running state ``at``, giving the arrays that it makes of each as one.

    Items go in chunks: each chunk's amount is combined with those before it, and every chunk then starts from its own state. So no
    array is longer than a chunk or the number of chunks while it grows, and long lists cost little more than their length.
    ``shared`` of a chunk's items and first state, if given, is worked out once a chunk and handed to each step.
    """

    def bound(x: Column, f) -> Column:
        return F.get(F.transform(F.array(x), f), F.lit(0))  # evaluates x once

    def over(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / chunk).cast("int")), lambda j: F.slice(xs, j * chunk + 1, F.lit(chunk)))
        return bound(chunks, along)

    def along(chunks: Column) -> Column:
        each = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda acc, x: combine(acc, amount(x))))
        return bound(each, lambda amounts: F.flatten(F.zip_with(chunks, before(amounts), within)))

    def before(amounts: Column) -> Column:
        state = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(amounts, state, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def within(c: Column, at: Column) -> Column:
        state = F.struct(at.alias("at"), F.array().cast(out).alias("out"))
        along = lambda *more: F.aggregate(c, state, lambda acc, x: F.struct(combine(acc["at"], amount(x)).alias("at"), F.concat(acc["out"], step(acc["at"], x, *more)).alias("out")), lambda acc: acc["out"])
        return bound(shared(c, at), lambda part: along(part)) if shared else along()

    return bound(items, over)


def _spans(text: Column, kind: str) -> Column:
    """Spans of the leftmost matches that do not overlap: a running sum over what stands between and in them."""
    pattern = F.lit(KINDS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    parts = F.arrays_zip(F.split(text, KINDS[kind], -1).alias("gap"), found.alias("hit"), value.alias("value"))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        keep = x["hit"].isNotNull()
        if kind == "assign":
            keep &= F.length(x["value"]) >= 6
        if kind == "mixed":
            keep &= x["hit"].rlike("[0-9]") & x["hit"].rlike("[a-z]") & x["hit"].rlike("[A-Z]")
        one = F.array(F.struct(start.alias("start"), F.lit(list(KINDS).index(kind)).alias("kind"), (start + F.length(x["hit"])).alias("end")))
        return F.when(keep, one).otherwise(F.array().cast(SPAN))

    return running(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)), lambda a, b: a + b, F.lit(0), step, SPAN)


def _spans_if(possible: Column, text: Column, kind: str) -> Column:
    return F.when(possible, _spans(text, kind)).otherwise(F.array().cast(SPAN))


def _named(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def parts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns as ``renamed``, a row number ``row``, ``base`` spans and ``weak`` spans of each row.

    Cheap tests come first, so that most texts are only searched for hexadecimal runs and a few letters. Weak
    kinds are searched for only where another part could complete them.
    """
    t = F.col("t")
    pairs = t.contains(":") | t.contains("=")
    rows = renamed(docs, keep, row=F.monotonically_increasing_id(), t=F.coalesce(F.col(quoted(text)), F.lit("")))
    rows = rows.withColumn("a", F.when(pairs, t.rlike(KINDS["assign"])).otherwise(False)).withColumn("u", F.when(pairs, t.rlike(KINDS["user"])).otherwise(False))
    base = F.concat(_spans_if(F.col("a"), t, "assign"), _spans_if(t.contains("AKIA"), t, "access"), _spans_if(t.rlike(KINDS["hex"]), t, "hex"))
    identified = F.col("u") | t.contains("AKIA")
    weak = F.concat(_spans_if(identified, t, "mixed"), _spans_if(F.col("u"), t, "user"), _spans_if(identified & t.contains("://"), t, "endpoint"))
    return rows.withColumn("base", base).withColumn("weak", weak).drop("t", "a", "u")


def linked(found: DataFrame) -> DataFrame:
    """Rows (row, linked): the weak spans whose complements are in scope, of rows that have any."""
    some = found.where(F.size("weak") > 0).select("row", "base", "weak")
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("p.kind") + 1)
    every = some.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", role.alias("role"), "p")
    stretches = F.explode(F.sequence((F.col("p.start") / SCOPE).cast("int"), ((F.col("p.end") - 1) / SCOPE).cast("int")))
    summary = every.select("row", stretches.alias("b"), "role", "p").groupBy("row", "b").agg(
        *[f(F.when(F.col("role") == r, F.col(f"p.{c}"))).alias(f"{r}_{c}") for r in ("identifier", "secret") for f, c in ((F.min, "start"), (F.max, "end"))]
    )
    low, high = F.col("p.start") - SCOPE, F.col("p.end") + SCOPE
    reach = F.explode(F.sequence(F.greatest(F.floor(low / SCOPE), F.lit(0)).cast("int"), (high / SCOPE).cast("int")))
    weak = some.select("row", F.explode("weak").alias("p")).select("row", "p", reach.alias("b"))
    near = {r: F.coalesce((F.col(f"{r}_end") >= low) & (F.col(f"{r}_start") <= high), F.lit(False)) for r in ("identifier", "secret")}
    met = weak.join(summary, ["row", "b"]).groupBy("row", "p").agg(*[F.max(v).alias(r) for r, v in near.items()])
    kind = {k: F.col("p.kind") == i for i, k in enumerate(KINDS)}
    # A mixed string is itself a secret and a user label an identifier, so each needs the other role.
    good = (kind["mixed"] & F.col("identifier")) | (kind["user"] & F.col("secret")) | (kind["endpoint"] & F.col("identifier") & F.col("secret"))
    return met.where(good).groupBy("row").agg(F.collect_list("p").alias("linked"))


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns as ``renamed`` with sorted ``base`` and ``every`` spans."""
    found = checkpointed(parts(docs, text, keep))
    plain, some = found.where(F.size("weak") == 0), found.where(F.size("weak") > 0)
    joined = some.join(linked(found), "row", "left").withColumn("linked", F.coalesce("linked", F.array().cast(SPAN)))
    rows = plain.withColumn("linked", F.array().cast(SPAN)).unionByName(joined)
    return rows.withColumn("every", F.array_sort(F.concat("base", "linked"))).withColumn("base", F.array_sort("base")).drop("weak", "linked", "row")


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``base_spans`` and ``all_spans`` (arrays of start, kind number, end), sorted.

    A text's spans are as bounded as the text is; rows without weak parts are not joined with anything. A kept column of one of
    these two names is dropped in their favour.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "all_spans")]
    return _found(docs, text, keep).select(*restored(keep), F.col("base").alias("base_spans"), F.col("every").alias("all_spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as a string."""
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == list(KINDS).index(k))).cast("long").alias(f"n_{k}")
    made = [*[count(k) for k in BASE], F.sha2(_named(F.col("base_spans")), 256).alias("base_sha256"), _named(F.col("all_spans")).alias("spans")]
    rest = [c for c in found.columns if c not in ("base_spans", "all_spans", *[f"n_{k}" for k in BASE], "base_sha256", "spans")]
    return found.select(*[F.col(quoted(c)) for c in rest], *made)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with each finding's text replaced by ``mark``; findings that overlap are one. Null texts stay null.

    A column ``__changed`` tells which rows have any; an input column of that name is dropped in its favour.
    """
    keep = [c for c in docs.columns if c != "__changed"]
    found = _found(docs, text, keep)
    t = F.col(f"k{keep.index(text)}")

    # a cut walks from the start of what it cuts, so each chunk of findings has its own stretch of the text cut out first
    def stretch(c: Column, at: Column) -> Column:
        return F.struct(at.alias("from"), t.substr(at + 1, F.greatest(F.array_max(F.transform(c, lambda s: s["start"])) - at, F.lit(0))).alias("text"))

    def piece(at: Column, s: Column, part: Column) -> Column:
        return F.when(s["start"] >= at, F.array(part["text"].substr(at - part["from"] + 1, s["start"] - at), F.lit(mark))).otherwise(F.array().cast("array<string>"))

    pieces = running(F.col("every"), lambda s: s["end"], lambda a, b: F.greatest(a, b), F.lit(0), piece, "array<string>", shared=stretch)
    tail = t.substr(F.array_max(F.transform("every", lambda s: s["end"])) + 1, F.length(t))
    changed = F.when(t.isNull() | (F.size("every") == 0), t).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return found.select(*[(changed if c == text else F.col(f"k{i}")).alias(c) for i, c in enumerate(keep)], (F.size("every") > 0).alias("__changed"))
