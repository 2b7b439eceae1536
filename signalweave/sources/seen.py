"""An index of the keys that a table has, so that a batch learns which of its keys are new at the cost of the batch.

Below one folder: ``keys`` (partitions bucket, batch: hashes of 128 bits) and ``filters`` (partition bucket: one Bloom filter of a fixed size).
A batch reads the filters of its own buckets, and the keys of those buckets alone in which a filter may have one of them. A filter never
denies a key that is there, so the answer is exact; with more keys than it is made for, more buckets are read, and ``rebuilt`` with
more buckets puts that right. A batch that runs again after a failure does not see what its first attempt has left of itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import first_per
from . import partitions

HASHES = 7


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key in a filter of ``bits`` bits."""
    pair = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (pair[:, :1] + np.arange(HASHES, dtype=np.uint64) * (pair[:, 1:] | np.uint64(1))) % np.uint64(bits)


def may_have(bits: np.ndarray, keys: list[bytes]) -> np.ndarray:
    at = places(keys, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def put(bits: np.ndarray, keys: list[bytes]) -> None:
    at = places(keys, len(bits) * 8).ravel()
    np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


class SeenKeys:
    """``filter_bytes`` a bucket do for about a key a byte with one false hit in a hundred or fewer."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, filter_bytes: int = 1 << 17):
        self.spark, self.path, self.buckets, self.filter_bytes = spark, path.rstrip("/"), buckets, filter_bytes

    def _hashed(self, rows: DataFrame, key: Column) -> DataFrame:
        rows = rows.withColumn("__h", F.unhex(F.md5(key.cast("string"))))
        return rows.withColumn("__b", F.pmod(F.xxhash64("__h"), F.lit(self.buckets)).cast("int"))

    def _read(self, part: str, buckets: list[int], schema: str) -> DataFrame:
        """Rows of one part in the given buckets, by their folders' names alone."""
        found = [p for b in buckets if partitions.exists(self.spark, p := f"{self.path}/{part}/bucket={b}")]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*found)

    def _filtered(self, keys: DataFrame, buckets: list[int]) -> DataFrame:
        """Rows (bucket, h, bits) of the keys (__b, __h): those that may be there, and each bucket's filter with the new keys (h null)."""
        size = self.filter_bytes

        def check(new: pa.Table, old: pa.Table) -> pa.Table:
            names = new.column("__h").to_pylist()
            bits = np.frombuffer(old.column("bits")[0].as_py(), dtype=np.uint8).copy() if old.num_rows else np.zeros(size, dtype=np.uint8)
            bucket = (new.column("__b") if new.num_rows else old.column("bucket"))[0].as_py()
            hits = [h for h, x in zip(names, may_have(bits, names)) if x] if names else []
            if names:
                put(bits, names)
            return pa.table({"bucket": pa.array([bucket] * (len(hits) + 1), pa.int32()), "h": pa.array([*hits, None], pa.binary()), "bits": pa.array([*[None] * len(hits), bits.tobytes()], pa.binary())})

        filters = self._read("filters", buckets, "bits binary, bucket int")
        return keys.groupBy("__b").cogroup(filters.groupBy("bucket")).applyInArrow(check, "bucket int, h binary, bits binary")

    def new_rows(self, rows: DataFrame, key: str, number: int, order: list[Column]) -> DataFrame:
        """The rows whose key no batch before ``number`` had, the first of each key; null keys are always new. Their keys are noted for later batches."""
        keyed = self._hashed(first_per(rows.where(F.col(key).isNotNull()), [F.col(key)], order), F.col(key)).persist(StorageLevel.DISK_ONLY)
        keys = keyed.select("__b", "__h")
        own = [r[0] for r in keys.select("__b").distinct().collect()]  # at most as many as there are buckets
        checked = self._filtered(keys, own).persist(StorageLevel.DISK_ONLY)
        hits = checked.where(F.col("h").isNotNull()).select("bucket", "h")
        read = [r[0] for r in hits.select("bucket").distinct().collect()]
        stored = self._read("keys", read, "h binary, bucket int, batch int").where(F.col("batch") < number)
        seen = hits.join(stored.select("h").distinct(), "h").select(F.col("h").alias("__h"))
        fresh = keyed.join(seen, "__h", "left_anti")
        noted = fresh.select(F.col("__h").alias("h"), F.col("__b").alias("bucket"), F.lit(number).alias("batch"))
        if own:
            partitions.overwrite(noted, f"{self.path}/keys", ["bucket", "batch"])
            partitions.overwrite(checked.where(F.col("bits").isNotNull()).select("bits", "bucket"), f"{self.path}/filters", ["bucket"])
        # what has been noted for this batch decides, so that rows computed again later are the same
        mine = self._read("keys", own, "h binary, bucket int, batch int").where(F.col("batch") == number).select(F.col("h").alias("__h"))
        out = self._hashed(first_per(rows.where(F.col(key).isNotNull()), [F.col(key)], order), F.col(key)).join(mine, "__h", "left_semi").select(*rows.columns)
        keyed.unpersist()
        checked.unpersist()
        return out.unionByName(rows.where(F.col(key).isNull()))

    def merge(self, upto: int) -> int:
        """Keys of batches up to number ``upto`` as one file a bucket."""
        return partitions.merge_batches(self.spark, f"{self.path}/keys", ["bucket"], upto, "h")

    def rebuilt(self, path: str, buckets: int, filter_bytes: int | None = None) -> SeenKeys:
        """The same keys in a new index, of more buckets or larger filters."""
        other = SeenKeys(self.spark, path, buckets, filter_bytes or self.filter_bytes)
        rows = self.spark.read.parquet(f"{self.path}/keys").select("h", "batch")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
        partitions.overwrite(rows, f"{other.path}/keys", ["bucket", "batch"])
        filters = other._filtered(rows.select(F.col("bucket").alias("__b"), F.col("h").alias("__h")), [])
        partitions.overwrite(filters.where(F.col("bits").isNotNull()).select("bits", "bucket"), f"{other.path}/filters", ["bucket"])
        return other
