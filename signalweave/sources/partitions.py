"""Partition folders by name: listing, dropping, merging, retention. Only names and the touched partitions' files are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import first_per


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, path)
    return files.exists(where)


def listed(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    """The values of partition ``name`` directly below a folder, each with its path."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return {}
    found = [s.getPath() for s in files.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith(name + "=")]
    return {p.getName()[len(name) + 1 :]: p.toString() for p in found}


def drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        files, where = _folder(spark, p)
        files.delete(where, True)


def overwrite(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes the partitions that df has rows of, each as few files, and leaves the others."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_batches(spark: SparkSession, path: str, by: list[str], upto: int, key: str) -> int:
    """Batches up to number ``upto`` of partitions by ``by`` and batch become one, of the last number; gives how many folders went.

    Partitions with one batch are left alone. Should a merge be cut short, rows may be there twice until it runs again, which keeps one row of a key.
    """
    folders = [{}]
    for name in by:
        folders = [f | {name: v, "path": p} for f in folders for v, p in listed(spark, f.get("path", path), name).items()]
    gone = []
    for f in folders:
        batches = {int(b): p for b, p in listed(spark, f["path"], "batch").items() if int(b) <= upto}
        if len(batches) < 2:
            continue
        rows = spark.read.option("basePath", path).parquet(*batches.values())
        kept = first_per(rows.where(F.col(key).isNotNull()), [F.col(key)], [F.asc("batch")]).unionByName(rows.where(F.col(key).isNull()))
        overwrite(kept.withColumn("batch", F.lit(max(batches))), path, [*by, "batch"])
        gone += [p for b, p in batches.items() if b != max(batches)]
    drop(spark, gone)
    spark.catalog.refreshByPath(path)
    return len(gone)


def retain(spark: SparkSession, path: str, as_of: str, days: int, enabled: bool, ts: str = "ts", name: str = "day") -> list[tuple[str, int]]:
    """Lets rows older than ``days`` before ``as_of`` go from a table partitioned by day (yyyy-MM-dd); gives (day, rows) of what goes.

    Whole days go by the name of their folder; only the day in which the limit falls is read and written again, and no other file changes. Rows of whole
    days are counted from the files' footers, since no column is read. Nothing goes unless it is enabled: the numbers are a dry run either way.
    """
    limit, edge = spark.range(1).select((F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")).alias("t")).select(F.col("t").cast("string"), F.date_format("t", "yyyy-MM-dd")).first()
    folders = listed(spark, path, name)
    old = sorted(d for d in folders if d < edge)
    gone = []
    if old:
        rows = spark.read.option("basePath", path).parquet(*[folders[d] for d in old])
        gone = [(str(r[0]), r[1]) for r in rows.groupBy(F.col(name).cast("string")).count().orderBy(name).collect()]  # one row a day
    if edge in folders:
        rows = spark.read.option("basePath", path).parquet(folders[edge])
        late = F.col(ts) < F.to_timestamp(F.lit(limit))
        if n := rows.where(late).count():
            gone.append((edge, n))
            if enabled:
                by = [c for c in rows.columns if f"/{c}=" in rows.select(F.input_file_name()).first()[0]]
                left = rows.where(~late | F.col(ts).isNull()).withColumn(name, F.lit(edge)).persist()
                if left.count():
                    drop(spark, [p for p in _stale(spark, folders[edge], left, by[1:], name)])
                    overwrite(left, path, by)
                else:
                    drop(spark, [folders[edge]])
                left.unpersist()
    if enabled:
        drop(spark, [folders[d] for d in old])
        spark.catalog.refreshByPath(path)
    return gone


def _stale(spark: SparkSession, folder: str, left: DataFrame, by: list[str], name: str) -> list[str]:
    """Folders below the edge day of which no row is left, which an overwrite by partition would not touch."""
    if not by:
        return []
    kept = {str(r[0]) for r in left.select(F.col(by[0]).cast("string")).distinct().collect()}  # values of one partition column in one day
    return [p for v, p in listed(spark, folder, by[0]).items() if v not in kept]
