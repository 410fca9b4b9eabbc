"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns documents with
the same columns; the last returns packed pieces. Between stages the documents are written as Parquet.
Decisions hold for a row's id and text together, so rows that share an id are judged each by its own
text; rows without id are judged like others but never paired; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontam, linedup, neardup, packing, quality
from quillstone.llm.queries import tokenizer_path
from quillstone.llm.shared import keep, table, without
from quillstone.sources.library import shipped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return without(docs, quality.quality(docs, table(spark, sf_dir, "labels")).where("NOT kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; every document stays, perhaps with an empty text."""
    return linedup.remove_lines(docs, linedup.line_overlaps(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return neardup.one_of_each(docs, keep(neardup.near_duplicates(docs)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return without(docs, decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packing.with_digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", shipped(quality_rules)),
    ("line_dedup", shipped(line_dedup)),
    ("minhash_near_dedup", shipped(minhash_near_dedup)),
    ("benchmark_decontamination", shipped(benchmark_decontamination)),
    ("packing", shipped(pack_sequences)),
]

#: Tokenizers and patience diff are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs)
    return docs
