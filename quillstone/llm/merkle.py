"""Merkle manifest of a dataset: a tree of hashes for each group of rows, a tree over the groups, and a proof for each row.

A parent's children are spread into fanout columns by conditional aggregates (the slot pivot). Concatenating the columns
gives the parent's hash; leaving out a child's own column gives its siblings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.shared import keep, sized
from quillstone.llm.urlfilter import LOWER, UPPER

FANOUT = 16


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its number of UTF-8 bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with at (place in the group from 0) and n (rows of the group).

    Range partitions are sorted, and each row's number in its partition is kept; a partition's first
    number of a group, and what the partitions before hold of it, make it the place. So a group may
    lie in any number of partitions, and only one number for each partition and group is summed up.
    """
    numbered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("number", F.monotonically_increasing_id())
    numbered = keep(numbered.withColumn("part", F.shiftright("number", 33)))
    runs = numbered.groupBy(group, "part").agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    runs = runs.withColumn("before", F.sum("rows").over(Window.partitionBy(group).orderBy("part")) - F.col("rows"))
    runs = runs.withColumn("n", F.sum("rows").over(Window.partitionBy(group)))
    runs = sized(keep(runs.select(group, "part", (F.col("before") - F.col("first")).alias("shift"), "n")), width=F.octet_length(group) + 24)
    return numbered.join(runs, [group, "part"]).withColumn("at", F.col("number") + F.col("shift")).drop("number", "part", "shift")


def slots(nodes: DataFrame, fanout: int) -> DataFrame:
    """The slot pivot: g, at (the parent's place), n (nodes of the group on the children's level), c0, c1, ... (children)."""
    slot = F.col("at") % fanout
    spread = [F.max(F.when(slot == i, F.col("child"))).alias(f"c{i}") for i in range(fanout)]
    return nodes.groupBy("g", F.floor(F.col("at") / fanout).alias("parent"), "n").agg(*spread).withColumnRenamed("parent", "at")


def parents(pivot: DataFrame, fanout: int) -> DataFrame:
    """The nodes that a pivot's rows are: g, at, n, child."""
    digest = F.sha2(F.concat_ws("", *(F.col(f"c{i}.digest") for i in range(fanout))), 256)
    return pivot.select("g", "at", F.ceil(F.col("n") / fanout).alias("n"), F.struct(digest.alias("digest")).alias("child"))


def children(pivot: DataFrame, fanout: int) -> DataFrame:
    """g, at, child and path of each child; path is the parent's path below the pair of strings of the child's earlier and
    later siblings. A lone node is its group's top and has no such pair."""
    digest = lambda i: F.col(f"c{i}.digest")
    each = []
    for i in range(fanout):
        beside = F.struct(F.concat_ws("", *map(digest, range(i))).alias("earlier"), F.concat_ws("", *map(digest, range(i + 1, fanout))).alias("later"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(beside), F.col("path")))
        each.append(F.when(F.col(f"c{i}").isNotNull(), F.struct((F.col("at") * fanout + i).alias("at"), F.col(f"c{i}").alias("child"), path.alias("path"))))
    inner = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")
    return pivot.select("g", "top", "root", inner).select("g", "top", "root", "x.at", "x.child", "x.path")


def grown(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels over leaves (g, at, n, child), the lowest first, and tops: g, digest, level (of the pivot from
    which a group's path goes down). Each level is written once and has a fanout-th of the rows of the one below."""
    level, found, most = keep(slots(leaves, fanout)), [], []
    while True:
        up = parents(level, fanout)
        found.append(level)
        lone = F.coalesce(*(F.col(f"c{i}.digest") for i in range(fanout)))
        if len(found) == 1:
            most.append(level.where("n = 1").select("g", lone.alias("digest"), F.lit(0).alias("level")))
        most.append(up.where("n = 1").join(level.where("n = 1").select("g"), "g", "left_anti").select("g", F.col("child.digest").alias("digest"), F.lit(len(found) - 1).alias("level")))
        left = up.where("n > 1")
        if left.isEmpty():
            return found, keep(reduce(DataFrame.union, most))
        level = keep(slots(left, fanout))


def descended(found: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """g, top, root, at, child and path of every leaf; tops: g, level, top, root, path. A level's pivot meets one path for each
    of its rows, so no key is hot."""
    paths = None
    for level in range(len(found) - 1, -1, -1):
        here = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("at"), "top", "root", "path")
        paths = here if paths is None else here.union(paths)
        each = children(found[level].join(paths, ["g", "at"]), fanout)
        paths = keep(each.select("g", "at", "top", "root", "path")) if level else each
    return paths


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tampered: str | None = None, fanout: int = FANOUT) -> DataFrame:
    """A leaf, its group's top, the root, and the proof for each row.

    A leaf is the hash of ``columns`` (see row_hash). In each group_col, leaves ascend by id_col;
    every ``fanout`` consecutive nodes become their parent until one is left, the group's top; tops
    by group_col, null first, grow into the root in the same way. Returns id_col, leaf, subroot, root, path
    (from the leaf upward, for each level the earlier and the later siblings' digests as strings) and, with ``tampered``, an SQL
    condition on rows whose text_col becomes lower case for A-Z, claimed: the leaf of the row as
    it is then, else the leaf itself. fold() and proof_hash() use them.

    Null ids come first and match no condition of theirs, equal ids ascend by leaf; rows equal in all columns have equal leaves and each a
    place of its own. Null groups are one group, empty ones another. A null field differs from an empty one. An
    empty table gives no rows. Other columns of docs are neither hashed nor returned. Texts are read once, and only
    hashes are shuffled.
    """
    leaf = row_hash(*(F.col(c) for c in columns))
    claimed = leaf
    if tampered is not None:
        changed = row_hash(*(F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in columns))
        claimed = F.when(F.coalesce(F.expr(tampered), F.lit(False)), changed)
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf.alias("leaf"), (claimed if tampered else F.lit(None).cast("string")).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    ordered = placed(keep(rows), "g", ["id", "leaf", "row"])  # written first, so that ranges are sampled from hashes, not from texts
    leaves = ordered.select("g", "at", "n", F.struct(F.col("leaf").alias("digest"), "id", "claimed").alias("child"))
    found, tops = grown(leaves, fanout)
    groups = placed(tops.select(F.lit("").alias("all"), "g", "digest", "level"), "all", ["g"])
    above, root = grown(groups.select(F.col("all").alias("g"), "at", "n", F.struct("digest", F.col("g").alias("group"), F.col("level").alias("below")).alias("child")), fanout)
    none = "CAST(array() AS array<struct<earlier:string,later:string>>)"
    start = root.select("g", "level", F.col("digest").alias("top"), F.col("digest").alias("root"), F.expr(none).alias("path"))
    tops = keep(descended(above, start, fanout).select(F.col("child.group").alias("g"), F.col("child.below").alias("level"), F.col("child.digest").alias("top"), "root", "path"))
    out = descended(found, tops, fanout)
    return out.select(F.col("child.id").alias(id_col), F.col("child.digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path", F.coalesce("child.claimed", "child.digest").alias("claimed"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x["earlier"], digest, x["later"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["earlier"], x["later"])), ""), 256)
