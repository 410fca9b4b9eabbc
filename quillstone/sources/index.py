"""Indexes on storage: postings in segments that are kept up to date, and trigrams for lookups of parts of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import join_hot, keep, sized

BUCKETS = 64
LOG = "version int, kind string, path string"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _places(spark: SparkSession, keys: list[str], buckets: int) -> list[int]:
    """Buckets of a query's few keys."""
    return sorted({r["bucket"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(_bucket("k", buckets)).collect()})


class PostingIndex:
    """Postings (token, path, ...) in a folder: segments, and a log of which paths each version replaced.

    A version writes a segment with the postings of new and changed paths and then a log entry, which
    also names the paths that are gone; a segment without an entry doesn't count, so a write that failed is as if it had never
    been, and the next one takes its place. A posting counts if no later version names its path and no later version is a
    compaction, which writes all that counts into one segment. One writer at a time; readers see whole versions.
    Within a segment, postings lie in folders by a hash of the token and are sorted by it.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def _versions(self) -> list[tuple[int, str]]:
        """Versions in order, with their kinds: one row for each write."""
        return sorted((r["version"], r["kind"]) for r in self._log().where("path IS NULL").select("version", "kind").collect())

    def _write(self, postings: DataFrame, version: int, kind: str, replaced: DataFrame | None) -> None:
        spread = F.pmod(F.xxhash64("path"), F.lit(8))  # so that a common token's postings are several files
        dealt = postings.withColumn("bucket", _bucket("token", self.buckets)).repartition("bucket", spread).sortWithinPartitions("bucket", "token")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={version}")
        entry = self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("path"))
        if replaced is not None:
            entry = entry.union(replaced.select(F.lit("path"), "path").distinct())
        entry.write.mode("overwrite").parquet(f"{self.folder}/log/version={version}")

    def create(self, postings: DataFrame) -> None:
        """The first version, in an empty folder."""
        self._write(postings, 0, "all", None)

    def update(self, postings: DataFrame, replaced: DataFrame) -> int:
        """A new version: the postings of new and changed paths, and the paths (path) that are new, changed or gone. Nothing
        else is read."""
        version = self._versions()[-1][0] + 1
        self._write(postings, version, "some", replaced)
        return version

    def read(self, terms: list[str] | None = None) -> DataFrame:
        """All postings that count, or those of some terms: then other buckets aren't read, and the tokens are pushed
        down to the files."""
        versions = self._versions()
        begin = max(v for v, kind in versions if kind == "all")
        live = [v for v, _ in versions if v >= begin]
        found = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("segment").isin(live))
        if terms is not None:
            found = found.where(F.col("bucket").isin(_places(self.spark, terms, self.buckets)) & F.col("token").isin(list(terms)))
        if len(live) > 1:
            newest = self._log().where((F.col("version") > begin) & (F.col("kind") == "path")).groupBy("path").agg(F.max("version").alias("newest"))
            newest = sized(keep(newest), width=F.octet_length("path") + 8)
            found = found.join(newest, "path", "left").where("newest IS NULL OR segment >= newest").drop("newest")
        return found.drop("segment", "bucket")

    def compact(self) -> int:
        """Writes all that counts as one segment; segments before it are read no more."""
        postings, version = self.read(), self._versions()[-1][0] + 1
        self._write(postings, version, "all", None)
        return version


def _grams(text: Column) -> Column:
    """The different runs of three characters; a shorter text is one itself."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, 3)))


def gram_postings(names: DataFrame) -> DataFrame:
    """gram, df, name: which of the different names (name) hold a run of three characters, and how many do."""
    each = keep(names.where("name IS NOT NULL").select("name").distinct().select(F.explode(_grams(F.col("name"))).alias("gram"), "name"))
    df = keep(each.groupBy("gram").agg(F.count("*").alias("df")))
    return join_hot(each, df, "gram", "df")


def save_grams(postings: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes gram_postings() once, in folders by a hash of the run and sorted by it, and the runs by themselves."""
    postings = keep(postings)
    spread = F.pmod(F.xxhash64("name"), F.lit(8))
    postings.withColumn("bucket", _bucket("gram", buckets)).repartition("bucket", spread).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/names")
    postings.groupBy("gram").agg(F.first("df").alias("df")).sort("gram").write.parquet(f"{folder}/grams")


def names_with(spark: SparkSession, folder: str, parts: list[str], buckets: int = BUCKETS) -> DataFrame:
    """part, name: the names in save_grams() that hold one of a query's few parts, letter by letter.

    A name that holds a part holds all of its runs, so only the postings of the part's rarest run are read, and these
    names are compared with it. A part of one or two characters is looked for in the runs, the empty
    part is in all names. Null names hold nothing.
    """
    grams, names = spark.read.parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/names")
    parts = sorted(set(parts))
    wanted = spark.createDataFrame([(p,) for p in parts], "part string")
    long_ = wanted.where("length(part) >= 3").select("part", F.explode(_grams(F.col("part"))).alias("gram"))
    runs = [r["gram"] for r in long_.select("gram").distinct().collect()]  # of the parts
    df = {r["gram"]: r["df"] for r in grams.where(F.col("gram").isin(runs)).collect()} if runs else {}
    rarest = {p: min((p[i : i + 3] for i in range(len(p) - 2)), key=lambda g: (df.get(g, 0), g)) for p in parts if len(p) >= 3}
    chosen = sorted({g for g in rarest.values() if g in df})
    found = []
    if chosen:
        pairs = F.broadcast(spark.createDataFrame([(p, g) for p, g in rarest.items() if g in df], "part string, gram string"))
        some = names.where(F.col("bucket").isin(_places(spark, chosen, buckets)) & F.col("gram").isin(chosen))
        found.append(some.join(pairs, "gram").where(F.contains("name", "part")).select("part", "name"))
    short = [p for p in parts if len(p) < 3]
    if short:
        test = reduce(Column.__or__, (F.contains("gram", F.lit(p)) for p in short))
        pairs = F.broadcast(spark.createDataFrame([(p,) for p in short], "part string"))
        found.append(names.where(test).select("name").distinct().join(pairs, F.contains("name", "part")).select("part", "name"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "part string, name string")


def changed_rows(old: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows of new whose value differs from old's or that old lacks, and the keys (key) that are such or gone."""
    both = new.select(key, F.col(value).alias("__new"), F.lit(True).alias("__here")).join(old.select(key, F.col(value).alias("__old"), F.lit(True).alias("__there")), key, "full")
    moved = keep(both.where("__here IS NULL OR __there IS NULL OR NOT (__new <=> __old)").select(key))
    return new.join(moved, key, "left_semi"), moved
