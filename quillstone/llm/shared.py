"""What several operators need: tables, lineage cuts and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.tables import BROADCAST_ROWS, is_small, join_hot, keep, shared_dir, sized, table

__all__ = ["BROADCAST_ROWS", "components", "fingerprint", "is_small", "join_hot", "keep", "shared_dir", "sized", "table", "without"]


def fingerprint(text_col: str) -> Column:
    """A hash of a whole text (null: empty), by which rows that share an id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of these (id_col, fp); a row stays if only its id, or only its text, is that of a rejected one."""
    free = [next(n for n in (f"__{x}" + "_" * i for i in range(99)) if n not in docs.columns) for x in ("id", "fp")]
    gone = sized(keep(rejected.select(F.col(id_col).alias(free[0]), F.col("fp").alias(free[1])).distinct()))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[free[0]]) & (fingerprint(text_col) == gone[free[1]]), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): (node, component), component the smallest node reached.

    Alternating large-star and small-star steps; every step is a grouped minimum (combined before
    the shuffle) joined back to the edges, so no component is ever gathered in one task. Self-loops
    and null ends are dropped; nodes without another edge don't appear.
    """
    star = edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    star = keep(star)
    seen = None
    for _ in range(most_rounds):
        both = star.union(star.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = keep(small.selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v")).where("u <> v").distinct())
        now = star.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    top = star.groupBy("v").agg(F.first("v").alias("component")).selectExpr("v AS node", "component")
    return star.selectExpr("u AS node", "v AS component").union(top)
