"""File trees with links, listed and read by the executors: a Python data source and what follows from its rows.

Executors must see the tree under one path, as on a shared mount. Trees in an object store have no links; scan_files() in
``files`` reads those.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.sources.library import ship
from quillstone.sources.tables import keep

ENTRIES = "dir string, name string, kind string, target string, size long"
#: Bytes of files that a task hands over at once, at least one file.
READ_BYTES = 8 << 20


class Directories(InputPartition):
    """Directories to list, each with everything below it or by itself."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class TreeReader(DataSourceReader):
    """Lists each real directory of a tree once. Partitions are directories: the root is broken down until there are as many
    as asked for; whatever lies below them is found by the tasks.

    Links to directories aren't followed, but reported with their real paths. Only a target that no partition comes to (outside
    the tree, or below a skipped name) is listed by the task that finds the link; tasks that find the same one list it again.
    """

    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.wanted = int(options.get("partitions", "64"))
        self.skipped = frozenset(json.loads(options.get("skip", "[]")))

    def partitions(self) -> list[Directories]:
        deep, flat = [self.root], []
        while deep and len(deep) < self.wanted:
            flat += deep
            deep = [target for d in deep for _, _, kind, target, _ in self.entries(d) if kind == "dir" and os.path.dirname(target) == d and not os.path.islink(target)]
        groups = [Directories(deep[i :: self.wanted], flat[i :: self.wanted]) for i in range(self.wanted)]
        return [g for g in groups if g.deep or g.flat]

    def entries(self, folder: str) -> Iterator[tuple]:
        """Rows of one directory; broken links, sockets and the like are passed over."""
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            yield folder, "", "unreadable", None, None
            return
        for e in found:
            if e.name in self.skipped:
                continue
            try:
                info = e.stat()
                if stat.S_ISDIR(info.st_mode):
                    yield folder, e.name, "dir", os.path.realpath(e.path) if e.is_symlink() else e.path, None
                elif stat.S_ISREG(info.st_mode):
                    yield folder, e.name, "file", None, info.st_size
            except OSError:
                continue

    def listed(self, target: str) -> bool:
        """Whether a partition comes to a directory by itself."""
        if target == self.root:
            return True
        below = target.removeprefix(self.root.rstrip("/") + "/")
        return below != target and not self.skipped.intersection(below.split("/"))

    def read(self, partition: Directories) -> Iterator[pa.RecordBatch]:
        todo = [(d, True) for d in partition.deep] + [(d, False) for d in partition.flat]
        own, seen, rows = {d for d, _ in todo}, set(), []
        while todo:
            folder, deep = todo.pop()
            if folder in seen:
                continue
            seen.add(folder)
            for row in self.entries(folder):
                rows.append(row)
                _, name, kind, target, _ = row
                if kind != "dir" or target in own:
                    continue
                if not self.listed(target) or deep and target == os.path.join(folder, name):
                    todo.append((target, True))
            if len(rows) >= 10_000:
                yield self.batch(rows)
                rows = []
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"dir": pa.string(), "name": pa.string(), "kind": pa.string(), "target": pa.string(), "size": pa.int64()}
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(kinds)}, pa.schema(kinds))


class FileTree(DataSource):
    """``spark.read.format("file_tree").load(root)``: a row for each entry of each real directory."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, partitions: int = 64) -> tuple[DataFrame, DataFrame]:
    """Files of a tree (path below root, size_bytes, real) and diagnostics (code, path).

    The result is that of a walk that goes depth first and by name, follows links, and enters each real directory once: the
    first path to it counts, at others there is SYMLINK_LOOP_SKIPPED. Names and patterns of the ignore lists, and
    ``exclude``, are neither entered nor listed. Broken links are passed over; a directory that can't be listed gives
    DIRECTORY_UNREADABLE.

    The first path is the least one, name by name, of those whose own directories were all entered
    by their first paths. It is found in rounds, each one join of directories with the paths of the round
    before; there are about as many rounds as the tree is deep.
    """
    ship(spark)
    spark.dataSource.register(FileTree)
    read = spark.read.format("file_tree").option("partitions", str(partitions)).option("skip", json.dumps(C.IGNORED_DIRS)).load(root)
    entries = keep(read.dropDuplicates(["dir", "name"]))
    folders = keep(entries.where("kind = 'dir'").select("dir", "name", "target"))

    def left(path: Column) -> Column:
        joined = F.array_join(path, "/")
        out = ~P.is_ignored(joined)
        for glob in exclude or []:
            out &= ~joined.rlike(P.ignore_regex(glob))
        return out

    top = spark.createDataFrame([(os.path.realpath(root), [], [])], "real string, path array<string>, trail array<string>")
    first, seen = top, None
    while True:
        # a path that comes to a directory again is of no use; without it, what an outdated path led to dies out
        below = folders.join(first.withColumnRenamed("real", "dir"), "dir").where("target <> dir AND NOT array_contains(trail, target)")
        below = below.select(F.col("target").alias("real"), F.array_append("path", F.col("name")).alias("path"), F.array_append("trail", F.col("dir")).alias("trail")).where(left(F.col("path")))
        both = below.groupBy("real").agg(F.min(F.struct("path", "trail")).alias("x")).select("real", "x.path", "x.trail")
        first = keep(top.union(both))
        mark = first.agg(F.sum(F.xxhash64("real", "path").cast("decimal(38,0)"))).first()[0]
        if mark == seen:
            break
        seen = mark
    here = first.select(F.col("real").alias("dir"), "path")
    at = F.array_append("path", F.col("name"))
    files = entries.where("kind = 'file'").join(here, "dir").where(left(at)).select(F.array_join(at, "/").alias("path"), F.col("size").alias("size_bytes"), F.concat_ws("/", F.regexp_replace("dir", "/$", ""), "name").alias("real"))
    ways = folders.join(here, "dir").where(left(at)).select(at.alias("way"), F.col("target").alias("dir"))
    again = ways.join(here, "dir").where("way <> path").select(F.lit("SYMLINK_LOOP_SKIPPED").alias("code"), F.array_join("way", "/").alias("path"))
    closed = entries.where("kind = 'unreadable'").join(here, "dir").select(F.lit("DIRECTORY_UNREADABLE"), F.array_join("path", "/"))
    return files, again.union(closed)


def read_tree(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of scan_tree() with content, null where a file can't be read, and the diagnostics FILE_UNREADABLE of those. The
    executors read; read_text() in ``files`` goes on from there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, contents = 0, 0, []
            for i, real in enumerate(batch.column(2).to_pylist()):
                try:
                    with open(real, "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
                size += len(contents[-1] or b"")
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(begin, i + 1 - begin) for k in (0, 1)] + [pa.array(contents, pa.binary())], ["path", "size_bytes", "content"])
                    begin, size, contents = i + 1, 0, []
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(begin) for k in (0, 1)] + [pa.array(contents, pa.binary())], ["path", "size_bytes", "content"])

    cores = files.sparkSession.sparkContext.defaultParallelism
    out = keep(files.select("path", "size_bytes", "real").repartition(max(cores, 64), "path").mapInArrow(read, "path string, size_bytes long, content binary"))
    return out, out.where("content IS NULL").select(F.lit("FILE_UNREADABLE").alias("code"), "path")
