"""Chat formatting: logged snapshots that longer conversations contain are dropped, the rest rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.shared import keep

SEEDS = [("h1", 11), ("h2", 23)]


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


def _turn_hash(seed: int, pos: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos, "role", F.col("role").isNull(), "text", F.col("text").isNull())


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv, pos (from 1), n (turns of the conversation), h1 and h2, the 128-bit hash of its first pos turns.

    The hash rolls by exclusive or over hashes of (pos, role, text), so each position enters it and one
    ordered pass suffices. Rows that repeat one of the same conversation are one turn. A row without
    conversation id is a conversation of its own with one turn, so such rows never meet in one task.
    """
    every = _turns(turns, conv_col, turn_col, role_col, text_col)
    t = every.where("conv IS NOT NULL")
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    t = t.withColumn("me", F.xxhash64(F.lit(1), "turn", F.col("turn").isNull(), "role", F.col("role").isNull(), "text", F.col("text").isNull()))
    t = t.withColumn("before", F.lag("me").over(w)).where("before IS NULL OR before <> me").withColumn("pos", F.row_number().over(w))
    rolling = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv", "pos", F.count("*").over(Window.partitionBy("conv")).alias("n"), *(F.bit_xor(_turn_hash(seed, F.col("pos"))).over(rolling).alias(h) for h, seed in SEEDS))
    alone = every.where("conv IS NULL").select("conv", F.lit(1).alias("pos"), F.lit(1).cast("long").alias("n"), *(_turn_hash(seed, F.lit(1)).alias(h) for h, seed in SEEDS))
    return t.union(alone)


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations that are no prefix of a longer one: conv, n_turns, h1, h2. Of equal ones the smallest id stays."""
    hashes = keep(prefix_hashes(turns, conv_col, turn_col, role_col, text_col))
    whole = hashes.where("pos = n").groupBy("h1", "h2", "n").agg(F.min("conv").alias("conv"))
    prefixes = hashes.where("pos < n").select("h1", "h2", F.col("pos").cast("long").alias("n")).distinct()
    return whole.join(prefixes, ["h1", "h2", "n"], "left_anti").select("conv", F.col("n").alias("n_turns"), "h1", "h2")


def render(turns: DataFrame, opening: str = "<|%s|>\n", closing: str = "<|end|>\n", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as training texts: conv_col, n_turns, rendered.

    Turns go by (turn, role, text); each is its role in ``opening``, its text and ``closing``. A null
    role or text is rendered as empty but differs from an empty one in comparisons; a row without
    conversation id is a conversation of one turn; repeated rows are one turn; an empty table gives no
    rows; other columns are not read; very long texts are rendered whole.
    """
    kept = keep(maximal(turns, conv_col, turn_col, role_col, text_col))
    every = _turns(turns, conv_col, turn_col, role_col, text_col)
    before, _, after = opening.partition("%s")
    put = lambda role, text: F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(after), F.coalesce(text, F.lit("")), F.lit(closing))
    t = every.where("conv IS NOT NULL").join(kept.select("conv").where("conv IS NOT NULL"), "conv", "left_semi")
    t = t.groupBy("conv").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    t = t.select("conv", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: put(x["role"], x["text"])), "").alias("rendered"))
    alone = every.where("conv IS NULL").select("conv", "role", "text", *(_turn_hash(seed, F.lit(1)).alias(h) for h, seed in SEEDS)).dropDuplicates(["h1", "h2"])
    alone = alone.join(kept.where("conv IS NULL").select("h1", "h2"), ["h1", "h2"], "left_semi")
    return t.union(alone.select("conv", F.lit(1).cast("long"), put(F.col("role"), F.col("text")))).withColumnRenamed("conv", conv_col)
