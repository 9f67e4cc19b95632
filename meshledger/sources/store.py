"""The state by buckets: a batch reads and writes only the buckets it touches.

Objects lie in a fixed number of buckets by the hash of what they are looked up by. A batch writes new versions of the
buckets it changes into a folder of its own, then a manifest that names the version of every bucket. The manifest is the
commit: until it is there the batch has not happened, and running it again replaces its folder. Versions that neither
the last nor the last but one manifest names are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.operators.apply import apply_changes
from meshledger.operators.salts import shuffled
from meshledger.operators.touched import LOOK, look_of
from meshledger.sources.state import empty_state, state_schema

BUCKETS = 256
BUCKET = "bucket"
#: Version of a snapshot that was there before the first batch.
BEFORE = -1


def bucket_of(object_type: Column, look: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(object_type, look), F.lit(buckets)).cast("int")


class FrameState:
    """A state that is one table: every look-up reads it, and what follows from changes is a whole new table."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys`` is staged."""
        rows = self.rows.withColumn(LOOK, look_of(F.col("object_type"), F.col("object_key")))
        return rows.join(shuffled(keys, keys.count()), ["object_type", LOOK], "left_semi").select(*self.rows.columns)

    def after(self, changes: DataFrame) -> DataFrame:
        return apply_changes(self.rows, changes)


@dataclass(frozen=True)
class Snapshot:
    """The state as one manifest names it: bucket -> batch that wrote its version."""

    spark: SparkSession
    store: StateStore
    versions: dict[int, int]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: only their folders are listed and read."""
        chosen = sorted(self.versions if buckets is None else set(buckets) & set(self.versions))
        if not chosen:
            return empty_state(self.spark)
        return self.spark.read.schema(state_schema()).parquet(*[self.store.folder(self.versions[b], b) for b in chosen])

    def _buckets(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys; never more than the store has."""
        found = keys.select(bucket_of(F.col("object_type"), F.col(LOOK), self.store.buckets).alias(BUCKET)).distinct()
        return [row[0] for row in found.collect()]

    def look_up(self, keys: DataFrame) -> DataFrame:
        return FrameState(self.rows(self._buckets(keys))).look_up(keys)

    def after(self, changes: DataFrame) -> DataFrame:
        """The new rows of the buckets that the changes touch, and of no others."""
        keys = changes.select("object_type", look_of(F.col("object_type"), F.col("object_key")).alias(LOOK)).distinct()
        return apply_changes(self.rows(self._buckets(keys)), changes)


@dataclass(frozen=True)
class StateStore:
    root: str
    buckets: int = BUCKETS

    def _version(self, batch: int) -> str:
        return f"{self.root}/state/batch={batch:012d}" if batch >= 0 else f"{self.root}/state/before"

    def folder(self, batch: int, bucket: int) -> str:
        return f"{self._version(batch)}/{BUCKET}={bucket}"

    def manifest(self, batch: int) -> str:
        return f"{self.root}/manifest/batch={batch:012d}" if batch >= 0 else f"{self.root}/manifest/before"

    def snapshot(self, spark: SparkSession, batch: int) -> Snapshot:
        """The state after a batch; ``BEFORE``: the one the first batch starts from."""
        if not exists(spark, self.manifest(batch) + "/_SUCCESS"):
            raise FileNotFoundError(f"no state after batch {batch}: {self.manifest(batch)}")
        rows = spark.read.schema("bucket int, batch long").parquet(self.manifest(batch)).collect()
        return Snapshot(spark, self, {r.bucket: r.batch for r in rows})

    def begin(self, spark: SparkSession, rows: DataFrame | None) -> None:
        """Write what the first batch starts from, unless it is there: nothing, or a snapshot of the inventory."""
        if not exists(spark, self.manifest(BEFORE) + "/_SUCCESS"):
            self._write(spark, empty_state(spark) if rows is None else rows, BEFORE, {})

    def commit(self, before: Snapshot, rows: DataFrame, batch: int) -> None:
        """Write the new rows of touched buckets, and the manifest after them."""
        self._write(before.spark, rows, batch, before.versions)
        self._drop_unused(before.spark, batch)

    def _write(self, spark: SparkSession, rows: DataFrame, batch: int, versions: dict[int, int]) -> None:
        """Rows of a bucket lie together and in order of their key, so that a reader's statistics on keys are narrow."""
        bucket = bucket_of(F.col("object_type"), look_of(F.col("object_type"), F.col("object_key")), self.buckets)
        placed = rows.withColumn(BUCKET, bucket)
        placed = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, "object_type", "object_key")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self._version(batch))
        written = {int(name.split("=")[1]): batch for name in listed(spark, self._version(batch)) if name.startswith(BUCKET + "=")}
        named = sorted((versions | written).items())
        spark.createDataFrame(named, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(self.manifest(batch))

    def _drop_unused(self, spark: SparkSession, batch: int) -> None:
        """Delete the versions that only the manifest before the last two names, then that manifest."""
        old = batch - 2
        if old < BEFORE or not exists(spark, self.manifest(old) + "/_SUCCESS"):
            return
        kept = set(self.snapshot(spark, batch - 1).versions.items())
        for bucket, version in self.snapshot(spark, old).versions.items():
            if (bucket, version) not in kept:
                delete(spark, self.folder(version, bucket))
        delete(spark, self.manifest(old))


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def listed(spark: SparkSession, path: str) -> list[str]:
    target, system = _path(spark, path)
    return [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


__all__ = ["BEFORE", "BUCKETS", "FrameState", "Snapshot", "StateStore", "bucket_of", "delete", "exists", "listed"]
