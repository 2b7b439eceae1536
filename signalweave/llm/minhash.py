"""Near-duplicates by MinHash, with candidates from a multi-index Hamming join over b-bit signatures.

A text's set is its distinct shingles of five words. Its signature has 40 symbols of 16 bits, the lowest bits of 40 minimum hashes; two
sets of Jaccard similarity s differ in a symbol with probability 1 - s. Signatures may differ in 19 symbols at most: at s = 0.85 that
fails with probability 2e-7, at 0.9 with 2e-10. They are cut into ten chunks of four symbols. By the pigeonhole principle two signatures
within 19 errors have a chunk with one error at most, so each chunk is a key four times, each time without one of its symbols:
every pair within the distance meets, whatever the errors are. What meets is compared by size and by the whole signature, and links are
confirmed on the full sets.

No group is expanded into pairs. Equal sets are one from the start. Of the smallest sets of its keys, each set is first compared with the
one that is nearest by signature, which leaves one component of most groups. From then on only sets of different components matter.
Of each key with several, those outside its largest component are compared by signature with all others of the key, in blocks of at
most ``most`` by ``most``; what may be a link makes components into families. A family's sets meet once, in pairs of blocks, where sets of different
components are compared whole until they are one or no possible pair is left: components are those of all links.

Cases: a null, empty or blank text has an empty set and is linked with nothing. Fewer than five words are one shingle. Texts of any length count
whole. Rows of one id are rows of one group each by its own text. Rows with a null id take the smallest id of their group, if any, and
are not kept. An empty table gives no rows. Kept columns may have any name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, join_all, map_texts, quoted, renamed, restored
from .components import components, local_roots

SHINGLE = 5
CHUNKS, WIDTH = 10, 4
SYMBOLS = CHUNKS * WIDTH
ERRORS = 2 * CHUNKS - 1  # with one error more, each chunk could have two
LINK = 85  # per cent
SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])
_RANDOM = np.random.default_rng(20240131)
_XOR, _ODD = _RANDOM.integers(0, 2**64, SYMBOLS, dtype=np.uint64), _RANDOM.integers(0, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; letters A-Z are lower-cased first."""
    words = text.lower().split()  # bytes: ASCII letters, and white space as in WORD
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip((ends - lengths).tolist(), ends[width - 1 :].tolist())], dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Symbols (sets x SYMBOLS) of sets that are not empty."""
    every = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for i in range(SYMBOLS):
            least = np.minimum.reduceat((every ^ _XOR[i]) * _ODD[i], starts)
            out[:, i] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def _sketch(texts: list[bytes]) -> list:
    sets = [shingles(t) for t in texts]
    full = [s for s in sets if len(s)]
    rows = iter(signatures(full)) if full else iter(())
    return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [next(rows).tobytes() if len(s) else None for s in sets]]


def symbols(column: pa.Array) -> np.ndarray:
    """A column of signatures as rows of symbols."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def chunk_keys(reps: DataFrame) -> DataFrame:
    """Rows (k, u): each chunk without one of its symbols, with the number of the chunk and of the symbol above bit 48."""

    def keys(batches):
        for batch in batches:
            u, sig = batch.column(0).to_numpy(), symbols(batch.column(1)).astype(np.int64)
            out = np.empty((len(u), SYMBOLS), dtype=np.int64)
            for i in range(SYMBOLS):
                a = i - i % WIDTH
                x, y, z = (j for j in range(a, a + WIDTH) if j != i)
                out[:, i] = (i << 48) | (sig[:, x] << 32) | (sig[:, y] << 16) | sig[:, z]
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), pa.array(np.repeat(u, SYMBOLS))], names=["k", "u"])

    return reps.select("u", "sig").mapInArrow(keys, "k long, u long")


def nearest(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """For each a of the pairs (a, b) the b with the nearest signature, if sizes and signatures allow a link at all."""
    side = lambda c: reps.select(F.col("u").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= LINK * F.greatest("na", "nb"))

    def check(batches):
        for batch in batches:
            errors = (symbols(batch.column(2)) != symbols(batch.column(3))).sum(1)
            good = np.flatnonzero(errors <= ERRORS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(errors[good].astype(np.int32))], names=["a", "b", "errors"])

    return near.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long, errors int").groupBy("a").agg(F.min(F.struct("errors", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, share: int = 512) -> DataFrame:
    """Those pairs (a, b) that are links by their full sets (u, hashes).

    Pairs meet by b, whose set goes to a task once for ``share`` of its partners, and partners stream past it.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    partners = dealt.join(sets.withColumnRenamed("u", "a"), "a").select("b", "part", "a", "hashes")
    centres = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("u", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "hashes")

    def check(batches):
        centre = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for b, a, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = np.frombuffer(h, dtype=np.uint64)
                if a is None:
                    centre = own
                    continue
                shared = common(centre, own)
                if 100 * shared >= LINK * (len(own) + len(centre) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return partners.unionByName(centres).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a")).mapInArrow(check, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[pa.Table]:
    """The rows of each combination of the columns ``names``, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in names]
        new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in names):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def allowed(x: int, others: np.ndarray, n: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Those of the others that may be linked with x by their sizes and signatures."""
    y = others[(100 * n[x] >= LINK * n[others]) & (100 * n[others] >= LINK * n[x])]
    return y[(sig[y] != sig[x]).sum(1) <= ERRORS]


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may be linked in groups (k, i, j) of rows (u, n, sig, own, member, label): rows (u, -, -) of the sets, and edges (-, a, b) that connect their labels.

    Rows that are ``own`` are compared with those that are ``member``. There are no more rows than sets, and no more edges than labels.
    """
    for table in groups(batches, ("k", "i", "j")):
        own, member, u, n, label = (table.column(c).to_numpy() for c in ("own", "member", "u", "n", "label"))
        sig, theirs = symbols(table.column("sig")), np.flatnonzero(member)
        used, edges = [], []
        for x in np.flatnonzero(own):
            y = allowed(x, theirs[label[theirs] != label[x]], n, sig)
            if len(y):
                used += [[x], y]
                edges.append(np.unique(label[y]))
                edges[-1] = np.stack([np.full(len(edges[-1]), label[x]), edges[-1]])
        if used:
            nodes, roots = local_roots(*np.concatenate(edges, axis=1))
            sets, apart = u[np.unique(np.concatenate(used))], nodes != roots
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sets), none(len(sets)), none(len(sets))], names=["u", "a", "b"])
            yield pa.RecordBatch.from_arrays([none(apart.sum()), pa.array(nodes[apart]), pa.array(roots[apart])], names=["u", "a", "b"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def link_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between labels: in groups (family, i, j) of rows (label, n, sig, hashes), sets of different components are compared whole."""
    for table in groups(batches, ("family", "i", "j")):
        label, n, sig = table.column("label").to_numpy(), table.column("n").to_numpy(), symbols(table.column("sig"))
        sets = [np.frombuffer(h.as_py(), dtype=np.uint64) for h in table.column("hashes")]
        component, every, found = np.unique(label, return_inverse=True)[1], np.arange(len(sets)), []
        for x in range(len(sets)):
            y = allowed(x, every[:x][component[:x] != component[x]], n, sig)
            while len(y):
                shared = common(sets[x], sets[y[0]])
                if 100 * shared >= LINK * (n[x] + n[y[0]] - shared):
                    found.append((label[x], label[y[0]]))
                    component[component == component[y[0]]] = component[x]
                y = y[1:]
                y = y[component[y] != component[x]]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _contested(met: DataFrame, reps: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The rows of keys with several components, dealt into groups (k, i, j) of at most about ``most`` owners and ``most`` members.

    Owners are what is outside a key's largest component as it is now; of two sets that are still apart later, one is an owner.
    """
    labelled = met.select("k", "u").join(labels, "u", "left").withColumn("label", F.coalesce("root", "u"))
    sizes = labelled.groupBy("k", "label").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum("c").alias("members"), F.max("c").alias("largest"), F.max_by("label", F.struct("c", "label")).alias("major"))
    several = checkpointed(sizes.where("members > largest").withColumn("all", F.col("members")))
    total = several.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    rows = join_all(labelled.select("k", "u", "label"), several, "k", "members", total).withColumn("own", F.col("label") != F.col("major"))
    rows = rows.withColumn("is", F.ceil((F.col("all") - F.col("largest")) / most).cast("int")).withColumn("js", F.ceil(F.col("all") / most).cast("int"))
    i, j = F.pmod(F.xxhash64("u", F.lit(1)), F.col("is")).cast("int"), F.pmod(F.xxhash64("u", F.lit(2)), F.col("js")).cast("int")
    rows = rows.withColumn("oi", i).withColumn("mj", j)
    as_member = rows.select("k", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.col("mj").alias("j"), "u", "own", "oi").select("k", "i", "j", "u", (F.col("own") & (F.col("oi") == F.col("i"))).alias("own"), F.lit(True).alias("member"))
    as_owner = rows.where("own").select("k", F.col("oi").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), "u", "mj").where("j <> mj").select("k", "i", "j", "u", F.lit(True).alias("own"), F.lit(False).alias("member"))
    labels = labelled.select("u", "label").distinct()
    return as_member.unionByName(as_owner).join(reps.select("u", "n", "sig"), "u").join(labels, "u")


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """Rows (family, u, label) with pairs of blocks (i, j), so that any two sets of a family meet in one, of 2 * ``most`` sets or so."""
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    rows = members.join(sizes, "family").withColumn("x", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.where("x <> y or blocks = 1").select("family", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "u", "label")


def links(reps: DataFrame, met: DataFrame, sets: DataFrame, most: int = 2048) -> DataFrame:
    """Rows (u, root): components over all links between the distinct sets ``reps`` (u, n, sig) that meet in ``met`` (k, u, first)."""
    stars = nearest(met.where("u <> first").select(F.col("u").alias("a"), F.col("first").alias("b")).distinct(), reps)
    labels = components(confirmed(checkpointed(stars), sets)).withColumnRenamed("node", "u")
    dealt = _contested(met, reps, labels, most).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    found = checkpointed(dealt.mapInArrow(possible, "u long, a long, b long").distinct())
    families = components(found.where("u is null").select("a", "b")).select(F.col("node").alias("label"), F.col("root").alias("family"))
    used = found.where("u is not null").select("u").join(labels, "u", "left").select("u", F.coalesce("root", "u").alias("label"))
    rows = _blocks(checkpointed(used.join(families, "label")), most).join(reps.select("u", "n", "sig"), "u").join(sets, "u")
    more = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(link_families, "a long, b long")
    above = components(more).select(F.col("node").alias("label"), F.col("root").alias("above"))
    every = met.select("u").distinct().join(labels, "u", "left").withColumn("label", F.coalesce("root", "u"))
    return every.join(above, "label", "left").select("u", F.coalesce("above", "label").alias("root"))


MADE = ["n_shingles", "component_id", "kept"]
SET = T.StructType([T.StructField("hashes", T.BinaryType()), T.StructField("own", T.BinaryType())])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(u, hashes) of each wanted (u, first_id, digest): the set of a row of that id, if its digest is that one."""
    rows = docs.join(wanted, F.col("id").eqNullSafe(F.col("first_id"))).select("u", "digest", "t")

    def sets(texts):
        found = [shingles(t).tobytes() for t in texts]
        return [found, [xxhash.xxh3_128_digest(x) for x in found]]

    return map_texts(rows, "t", SET, sets, ["u", "digest"], as_bytes=True).where("own = digest").select("u", "hashes")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, most: int = 2048) -> DataFrame:
    """The id and kept columns with ``n_shingles`` (size of the set), ``component_id`` (the smallest id of the document's group) and ``kept``
    (whether the row has that id); a kept column of one of these names is dropped."""
    keep = [c for c in keep or [] if c not in (doc_id, *MADE)]
    texts = renamed(docs, [], id=F.col(quoted(doc_id)), t=F.col(quoted(text)))
    marked = map_texts(renamed(docs, keep, id=F.col(quoted(doc_id)), t=F.col(quoted(text))), "t", SKETCH, _sketch, ["id", *[f"k{i}" for i in range(len(keep))]], as_bytes=True)
    marked = checkpointed(marked)
    full = marked.where("n > 0").groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = checkpointed(full.withColumn("u", F.monotonically_increasing_id()))
    keys = chunk_keys(reps)
    counts = checkpointed(keys.groupBy("k").agg(F.count("*").alias("c"), F.min("u").alias("first")).where("c > 1"))
    met = checkpointed(join_all(keys, counts, "k", "c", reps.count() * SYMBOLS))
    wanted = reps.select("u", "first_id", "digest").join(met.select("u").distinct(), "u")
    roots = links(reps, met, checkpointed(_sets(texts, wanted)), most)
    joined = checkpointed(reps.select("u", "digest", "rows", "first_id").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u")))
    least = checkpointed(joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("members")))
    total = marked.count()
    of = checkpointed(join_all(joined.select("root", "digest", "rows"), least, "root", "members", total).select("digest", "rows", "component_id"))
    grouped = join_all(marked.where("n > 0").drop("sig"), of, "digest", "rows", total).drop("digest")
    alone = marked.where("n = 0").drop("sig", "digest").withColumn("component_id", F.col("id"))
    every = grouped.unionByName(alone)
    return every.select(F.col("id").alias(doc_id), *restored(keep), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
