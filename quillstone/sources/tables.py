"""Tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of fixed-width columns is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a side with strings or arrays is broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan has fewer tasks than there are cores, as small tables have; a larger table is not
    shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local master, whose executors share the driver's disk,
    gets a folder of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within the block keep() writes below one folder, which is deleted at its end; results must have been written elsewhere
    by then. Without it, what is kept stays until the shared folder is cleaned, since a lazy result may still read it."""
    folder = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_scratch[-1] if _scratch else shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: any executor may be lost afterwards, and plans stay short."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int | None = None, width: Column | None = None, most_bytes: int | None = None) -> bool:
    """Whether df, which must be cheap to count (kept), has at most so many rows and, where ``width`` gives a row's bytes, so
    many bytes."""
    rows, most_bytes = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if most_bytes is None else most_bytes
    small = df.limit(rows + 1).count() <= rows
    return small and (width is None or (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes)


def sized(df: DataFrame, rows: int | None = None, width: Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is small (see is_small)."""
    return F.broadcast(df) if is_small(df, rows, width, most_bytes) else df


def apart(df: DataFrame) -> DataFrame:
    """df for joins within loops: Spark shuffles them by the key and never sends a side through the driver, which would add
    up over the rounds."""
    return df.hint("merge")


def join_hot(rows: DataFrame, side: DataFrame, key: str, n: str, parts: int = 20_000) -> DataFrame:
    """rows joined to side (one row for each key, with the number n of rows that the key has).

    Keys that hold more than a ``parts``-th of all rows, of which there can be at most ``parts``,
    are broadcast, so that none of them fills a task; the others shuffle. side must be kept.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = side.where(F.col(n) * parts > total)
    if hot.isEmpty():
        return rows.join(side, key)
    beside = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")  # at most `parts` rows
    often = beside.where("__hot").drop("__hot").join(F.broadcast(hot), key)
    return often.unionByName(beside.where("__hot IS NULL").drop("__hot").join(side.where(F.col(n) * parts <= total), key))


def running(rows: DataFrame, key: str, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a running sum for each name in ``sums``, within key and in the order of columns that tell its rows apart.

    On two levels: rows are dealt by ranges of (key, order) and summed up within a range; what the ranges before hold of a
    key is one row for each range and key. So no task gets more than a range, whatever share of the rows a key has.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in (key, *order)]
    sorted_ = rows.withColumns(sums).repartitionByRange(*by).sortWithinPartitions(*by)
    part = keep(sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright(F.monotonically_increasing_id(), 33)))
    totals = part.groupBy(key, "__p").agg(*(F.sum(n).alias(f"__{n}") for n in sums))
    before = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keep(totals.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums)))
    here = Window.partitionBy("__p", key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inner = part.withColumns({n: F.sum(n).over(here) for n in sums})
    out = inner.join(ahead, (F.col("__p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__k")))
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__at", "__p", "__q", "__k", *(f"__{n}" for n in sums))
