"""Near-duplicates by SimHash, with candidates from the pigeonring principle.

Fingerprints of 64 bits are cut into 16 segments of 4 bits on a ring. If two differ in at most 4 bits, some
segment starts a chain in which every first l segments hold at most l * 4 / 16 differences: its first three
are equal, its first seven hold one difference at most, its first eleven two, its first fifteen three. So with
each start as a key, the three equal segments and three of the next four select the candidates (64 keys of
24 bits a fingerprint), the whole chain condition prunes them, and only then all 64 bits are compared.

Equal fingerprints are one from the start, and a task never hands on pairs: it links what it finds
into trees, at most one edge a fingerprint. A key with more than ``most`` fingerprints is dealt out again in
blocks, each pair of blocks to a task. Components over the trees give the groups.

Cases: a null, empty or blank text has fingerprint zero and is linked like any other. Fewer than four words are
one shingle. A document linked with none is its own component. Several rows of one id are rows of
one group each by its own text. Rows with a null id keep a fingerprint and take the smallest id of their group, if any. An empty table
gives no rows. Texts of any length count whole, with one number a shingle in memory for the text at hand. Kept columns may have any name; only a name that the result itself has is taken from them.
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

SEGMENTS, WIDTH, BUDGET = 16, 4, 4
FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of each shingle; letters A-Z are lower-cased first."""
    words = text.lower().split()  # bytes: ASCII letters, and white space as in WORD
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip((ends - lengths).tolist(), ends[width - 1 :].tolist())]
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with the fingerprint as a signed long ``fp``."""
    return map_texts(docs, text, FINGERPRINT, lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)], docs.columns if keep is None else keep, as_bytes=True)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits)) if bits else x


def chained(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps its budgets: after l segments l * BUDGET / SEGMENTS."""
    diff = _rotated(a ^ b, start * WIDTH)
    ok = np.ones(len(diff), dtype=bool)
    for budget in range(BUDGET):  # the longest chain that may hold just ``budget`` differences
        segments = (budget + 1) * SEGMENTS // BUDGET - 1
        ok &= np.bitwise_count(diff >> np.uint64(64 - segments * WIDTH)) <= budget
    return ok


def linked(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """Places of the pairs that pass the chain condition and then the whole comparison."""
    at = np.flatnonzero(chained(a, b, start))
    return at[np.bitwise_count(a[at] ^ b[at]) <= BUDGET]


def link_group(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is within the budget in one large group, without comparing all pairs if it's close.

    Each pivot takes all within reach, which connects these; further comparisons are made only from
    members outside the largest component found so far. Exact for the components of the group.
    """
    edges, free = [], np.ones(len(fps), dtype=bool)
    while free.any():
        pivot = fps[np.argmax(free)]
        near = np.bitwise_count(fps ^ pivot) <= BUDGET
        free &= ~near
        edges.append((np.full(near.sum(), pivot), fps[near]))
    nodes, roots = local_roots(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
    kinds, sizes = np.unique(roots, return_counts=True)
    if len(kinds) > 1:
        for x in nodes[roots != kinds[sizes.argmax()]]:
            near = fps[np.bitwise_count(fps ^ x) <= BUDGET]
            if len(near) > 1:
                edges.append((np.full(len(near), x), near))
    return edges


def link_keys(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Edges among rows (k, fp) sorted by k; rows of keys with more than ``most`` go on as they are.

    k's low 40 bits hold what the fingerprints share, the start above them.
    """
    found_u: list[np.ndarray] = []
    found_v: list[np.ndarray] = []
    held = 0

    def rows(k, u, v):
        for i in range(0, len(u), 100_000):
            part = [pa.array(np.ascontiguousarray(x[i : i + 100_000]).view(np.int64), pa.int64()) if x is not None else pa.nulls(min(100_000, len(u) - i), pa.int64()) for x in (k, u, v)]
            yield pa.RecordBatch.from_arrays(part, names=["k", "a", "b"])

    def add(u, v):
        nonlocal held
        if len(u):
            found_u.append(u)
            found_v.append(v)
            held += len(u)
        if held > 500_000:
            nodes, roots = local_roots(np.concatenate(found_u), np.concatenate(found_v))
            found_u[:], found_v[:] = [nodes[nodes != roots]], [roots[nodes != roots]]
            held = 0

    def close(k, fp):
        """All whole groups: small ones together, neighbour by neighbour; the others one by one."""
        bounds = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        sizes = np.diff(bounds)
        start = k >> np.uint64(40)
        small = np.repeat(sizes <= 64, sizes)
        for step in range(1, int(min(64, sizes.max())) if len(sizes) else 0):
            i = np.flatnonzero((k[step:] == k[:-step]) & small[step:])
            if not len(i):
                break
            for s in range(SEGMENTS):
                own = i[(start[i] & np.uint64(15)) == s]
                if len(own):
                    at = own[linked(fp[own], fp[own + step], s)]
                    add(fp[at], fp[at + step])
        for n in np.flatnonzero(sizes > 64):
            for u, v in link_group(np.unique(fp[bounds[n] : bounds[n + 1]])):
                add(u, v)

    k, fp = np.empty(0, np.uint64), np.empty(0, np.uint64)
    too_large = None
    for batch in batches:
        new_k, new_fp = (np.asarray(batch.column(i)).astype(np.int64).view(np.uint64) for i in (0, 1))
        if too_large is not None:
            same = new_k == too_large
            yield from rows(new_k[same], new_fp[same], None)
            new_k, new_fp = new_k[~same], new_fp[~same]
            if not len(new_k):
                continue
            too_large = None
        k, fp = np.concatenate([k, new_k]), np.concatenate([fp, new_fp])
        last = int(np.searchsorted(k, k[-1]))
        if most:  # whole groups that are too large, then perhaps the one that is not ended yet
            bounds = np.flatnonzero(np.concatenate(([True], k[1:last] != k[: max(last - 1, 0)], [True]))) if last else np.array([0])
            drop = np.repeat(np.diff(bounds) > most, np.diff(bounds)) if last else np.zeros(0, bool)
            yield from rows(k[:last][drop], fp[:last][drop], None)
            close(k[:last][~drop], fp[:last][~drop])
            if len(k) - last > most:
                too_large = k[-1]
                yield from rows(k[last:], fp[last:], None)
                last = len(k)
        else:
            close(k[:last], fp[:last])
        k, fp = k[last:], fp[last:]
    if len(k):
        close(k, fp)
    if found_u:
        nodes, roots = local_roots(np.concatenate(found_u), np.concatenate(found_v))
        yield from rows(None, nodes[nodes != roots], roots[nodes != roots])


def chain_keys(fps: DataFrame) -> DataFrame:
    """Rows (k, fp): for each start and each of the four later segments, the other six of the chain's first seven."""
    ring = "shiftleft(fp, 4 * s) | IF(s = 0, 0L, shiftrightunsigned(fp, 64 - 4 * s))"
    seven = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("s")).selectExpr("fp", "s", f"shiftrightunsigned({ring}, 36) AS seven")
    left_out = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o")
    # low to high: 28 bits of the chain with the segment left out zeroed, its number, and from bit 40 the start
    return seven.select("fp", "s", "seven", left_out).selectExpr("(seven & ~shiftleft(15L, 4 * o)) | shiftleft(CAST(o AS BIGINT), 28) | shiftleft(CAST(s AS BIGINT), 40) AS k", "fp")


def links(fps: DataFrame, most: int = 4096) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within the budget."""
    schema = "k long, a long, b long"
    keyed = chain_keys(fps)
    first = checkpointed(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(lambda x: link_keys(x, most), schema))
    edges = first.where("k is null").select("a", "b")
    large = first.where("k is not null").select("k", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    # Each member meets each block of its key: itself in block i goes to the pairs (i, 0) ... (i, n - 1).
    blocks = large.groupBy("k").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    dealt = large.join(blocks, "k").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = F.xxhash64("k", F.least("i", "j"), F.greatest("i", "j"))
    # Members of one key agree in the chain, so any key that is equal just for the pair of blocks serves; the start stays in its place.
    dealt = dealt.select((pair.bitwiseAND(F.lit((1 << 40) - 1))).bitwiseOR(F.expr("k & ~1099511627775L")).alias("k"), "fp")
    rest = dealt.repartition("k").sortWithinPartitions("k").mapInArrow(lambda x: link_keys(x, None), schema)
    return edges.unionByName(rest.select("a", "b"))


MADE = ["fp", "component_id"]


def _grouped(docs: DataFrame, text: str, doc_id: str, keep: list[str], most: int) -> DataFrame:
    """(id, fp, component_id) with the kept columns as ``renamed``.

    Rows of equal fingerprints, and fingerprints of one large component, may be most of all; both joins take such keys by broadcast.
    """
    marked = checkpointed(fingerprints(renamed(docs, keep, id=F.col(quoted(doc_id)), t=F.col(quoted(text))), "t", ["id", *[f"k{i}" for i in range(len(keep))]]))
    total = marked.count()
    groups = marked.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    roots = components(links(groups.select("fp"), most))
    joined = checkpointed(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")))
    least = checkpointed(joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")))
    of = checkpointed(join_all(joined.select("root", "fp", "n"), least, "root", "members", total).select("fp", "n", "component_id"))
    return join_all(marked, of, "fp", "n", total)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, most: int = 4096) -> DataFrame:
    """The id and kept columns with ``fp`` and ``component_id``, the smallest id of the document's group; a kept column of one of these names is dropped."""
    keep = [c for c in keep or [] if c not in (doc_id, *MADE)]
    return _grouped(docs, text, doc_id, keep, most).select(F.col("id").alias(doc_id), *restored(keep), *MADE)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 4096) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays.

    Of several rows of that id one stays, of rows with a null id in a group without ids one. Rows are numbered once, in a checkpoint.
    """
    names = docs.columns
    numbered = checkpointed(renamed(docs, names, row=F.monotonically_increasing_id()))
    at = {c: f"k{i}" for i, c in enumerate(names)}
    found = _grouped(numbered, at[text], at[doc_id], ["row"], most)
    chosen = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("k0"))).alias("row"))
    return numbered.join(chosen.select("row"), "row", "left_semi").select(*restored(names))
