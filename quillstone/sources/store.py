"""Cached results on storage: rows replaced by key without touching the rest, and joins that leave what is stored in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import keep


class KeyedStore:
    """Rows in folders by a hash of their key. Replacing or deleting keys reads and writes the folders of these keys only,
    by dynamic partition overwrite; all other folders keep their files.

    Every folder has one row without a key, so that a folder all of whose rows go is written, too. Readers
    don't see it. Null keys can't be stored. One writer at a time; a write that fails leaves each folder as it was or as it is
    to be, and can be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 256):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, places: DataFrame) -> None:
        marks = places.select("bucket", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "bucket"))
        out = rows.unionByName(marks).repartition("bucket").sortWithinPartitions("bucket", self.key)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def create(self, rows: DataFrame) -> None:
        self._write(self._placed(rows), self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")))

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def read(self) -> DataFrame:
        return self._all().where(F.col(self.key).isNotNull()).drop("bucket")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> list[int]:
        """Rows of the keys (by default those of ``rows``) give way to ``rows``; keys without new rows are deleted. Returns
        the folders that were written, a number for each at most."""
        new = keep(self._placed(rows))
        gone = self._placed(keys.select(self.key) if keys is not None else rows.select(self.key)).union(new.select(self.key, "bucket")).distinct()
        gone = keep(gone)
        places = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())
        if not places:
            return []
        old = self._all().where(F.col("bucket").isin(places) & F.col(self.key).isNotNull())
        left = old.join(gone, ["bucket", self.key], "left_anti").select(*new.columns)
        self._write(keep(left.unionByName(new)), gone.select("bucket").distinct())
        return places


class StoredVersion:
    """A version of a table, dealt into files by a hash of its keys and sorted by them: joins with it by these keys shuffle the
    other side only, into as many partitions."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 200):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.name = f"version_{uuid.uuid4().hex}"

    def save(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, *self.keys)  # so that each bucket is one file
        dealt.write.mode("overwrite").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", self.folder).format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def split(self, now: DataFrame, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows of ``now`` whose keys are stored with the same value (hits), its other rows (misses: new or changed), and stored
        rows whose keys ``now`` lacks (gone). ``now`` is dealt like the stored table, once."""
        here = now.repartition(self.buckets, *self.keys)
        stored = self.read()
        then = stored.select(*self.keys, value)
        # The value is compared beside the keys: as a key of its own it would ask for another partitioning.
        alike = lambda a, b: F.coalesce(a[value] == b[value], a[value].isNull() & b[value].isNull())
        on = lambda a, b: [a[c] == b[c] for c in self.keys]
        hits = here.join(then, [*on(here, then), alike(here, then)], "left_semi")
        misses = here.join(then, [*on(here, then), alike(here, then)], "left_anti")
        present = here.select(*self.keys)
        return hits, misses, stored.join(present, on(stored, present), "left_anti")

