"""Keyed state as a log of changes in hash buckets of Parquet.

A batch writes the rows it changes, dealt into the buckets of their keys; reading takes the newest row of each key, from
the buckets that are asked for. A bucket with many parts is rewritten into one. So a batch writes in proportion to
its changes, and reads only the buckets it touches.

``store_part=N/store_bucket=B`` holds rows, ``commit=V`` which parts make up each bucket in version V, and the query and epoch that wrote it. A batch
that is run again finds its own commit, starts from the version before, and writes the same version once more. Parts that neither the newest
version nor the one before needs are removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
MOST_PARTS = 8
"""Parts of a bucket, beyond which it is rewritten."""
COMMIT = "query_id string, epoch long, keys array<string>, bucket int, parts array<long>"
GONE = "_gone"
PART, BUCKET = "store_part", "store_bucket"  # columns of the files that no state should have


def path_of(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it names it."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def names_in(spark: SparkSession, path: str) -> list[str]:
    store, name = path_of(spark, path)
    return [f.getPath().getName() for f in store.listStatus(name)] if store.exists(name) else []


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix``N that a finished write left under a path."""
    store, _ = path_of(spark, path)
    return sorted(int(n[len(prefix):]) for n in names_in(spark, path) if n.startswith(prefix)
                  and store.exists(path_of(spark, f"{path}/{n}/_SUCCESS")[1]))


def query_id(spark: SparkSession) -> str:
    """The running streaming query, or '' in a call of one's own."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def newest_version(spark: SparkSession, path: str) -> int:
    """The last committed version, -1 without one."""
    return max(numbers(spark, path, "commit="), default=-1)


class KeyedStore:
    """State under a path. ``dealt_by`` are the key columns whose hash names the bucket; all of them by default."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = (), dealt_by: Sequence[str] = (),
                 buckets: int = BUCKETS, most_parts: int = MOST_PARTS):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.buckets, self.most_parts = list(keys), buckets, most_parts
        self.dealt_by = list(dealt_by or keys)
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.dealt_by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows, at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def commit(self, version: int) -> list:
        """The rows of a commit, one for each bucket that holds anything."""
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commit={version}").collect() if version >= 0 else []

    def base_version(self, epoch: int) -> int:
        """The version a batch starts from: the newest one, or the one before it if this batch wrote the newest."""
        newest = newest_version(self.spark, self.path)
        rows = self.commit(newest)
        if rows and (rows[0]["query_id"], rows[0]["epoch"]) == (query_id(self.spark), epoch):
            return newest - 1
        return newest

    def read(self, version: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest row of each key in a version, of all buckets or some."""
        rows = self.commit(version)
        return self._newest({r["bucket"]: r["parts"] for r in rows if r["bucket"] is not None and (buckets is None or r["bucket"] in buckets)},
                            rows[0]["keys"] if rows else self.keys)

    def _newest(self, parts: dict[int, list[int]], keys: list[str]) -> DataFrame:
        folders = [f"{self.path}/{PART}={p}/{BUCKET}={b}" for b, held in parts.items() for p in held]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, {GONE} boolean, {PART} long, {BUCKET} int").option("basePath", self.path).parquet(*folders)
        rest = [c for c in self.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, GONE), PART).alias("r")).where(~F.col(f"r.{GONE}"))
        return newest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in self.columns])

    def write(self, changes: DataFrame, base: int, epoch: int, gone: DataFrame | None = None) -> None:
        """The version after ``base``: with changed or new rows, one for each key, and without the keys of ``gone``."""
        rows = changes.select(*self.columns, F.lit(False).alias(GONE))
        if gone is not None:
            rows = rows.unionByName(gone.select(*self.keys, F.lit(True).alias(GONE)), allowMissingColumns=True)
        parts = {r["bucket"]: list(r["parts"]) for r in self.commit(base) if r["bucket"] is not None}
        version = base + 1
        for b in self._put(rows, 2 * version):
            parts.setdefault(b, []).append(2 * version)
        many = {b: held for b, held in parts.items() if len(held) > self.most_parts}
        if many:
            whole = self._newest(many, self.keys).withColumn(GONE, F.lit(False))
            filled = self._put(whole, 2 * version + 1)
            for b in many:
                parts[b] = [2 * version + 1] if b in filled else []
        head = (query_id(self.spark), epoch, self.keys)
        self.spark.createDataFrame([(*head, b, held) for b, held in parts.items() if held] or [(*head, None, [])], COMMIT).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/commit={version}")
        self._clean(version, {(2 * version, b) for b in many})

    def _put(self, rows: DataFrame, part: int) -> list[int]:
        """Write rows by bucket; the buckets that got any."""
        to = f"{self.path}/{PART}={part}"
        # few files a bucket, and several for one with many rows
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(to)
        return sorted(int(n.partition("=")[2]) for n in names_in(self.spark, to) if n.startswith(f"{BUCKET}="))

    def _clean(self, version: int, replaced: set[tuple[int, int]]) -> None:
        """Remove parts of buckets that the version before last was the last to need, and new ones that were replaced at once."""
        def folders(v: int) -> set[tuple[int, int]]:
            return {(p, r["bucket"]) for r in self.commit(v) if r["bucket"] is not None for p in r["parts"]} if v >= 0 else set()

        old = folders(version - 2) - folders(version - 1) - folders(version) if version >= 2 else set()
        for part, b in old | replaced:
            store, name = path_of(self.spark, f"{self.path}/{PART}={part}/{BUCKET}={b}")
            store.delete(name, True)
