"""One query for each operator of this folder, over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, chat, decontam, licenses, linedup, merkle, neardup, packing, quality, secrets, tokens, urlfilter, vectorcodes
from quillstone.llm.oracles import ORACLES
from quillstone.llm.shared import table

#: The rules that the URL query judges by (action, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies: the installed package's folder, or that of QUILLSTONE_TOKENIZERS."""
    if folder := os.environ.get("QUILLSTONE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", F.col("cutoff").cast("long").alias("cutoff"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = linedup.line_overlaps(docs)
    left = linedup.remove_lines(docs.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit("")))), found)
    left = left.select(F.col("doc_id").alias("id"), F.col("fp").alias("of"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))
    out = left.join(found, left["id"].eqNullSafe(found["doc_id"]) & (left["of"] == found["fp"]))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed_lines"), "n_removed_words", F.array_join("removed", ",").alias("removed"), F.size("blocks").cast("long").alias("n_blocks"), F.size(F.array_distinct("blocks.partner")).cast("long").alias("n_partners"), "n_chars_left", "text_sha256")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("array_sort(concat(base, added))").alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).drop("fp", "component_fp")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("identifiers", "|").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"), "unmatched")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.sha2(F.lit(vectorcodes.flattened(books)), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered="crc32(CAST(doc_id AS string)) % 5 = 0")
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.share_vocabulary(spark, tokenizer_path("word_bpe_49k.json"))
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_chat_snapshots, op2_quality_rules, op3_line_dedup, op4_secret_scan, op5_minhash_near_dedup, op6_url_filter, op7_token_counts, op8_packing, op9_decontamination, op10_license_scan, op11_vector_codes, op12_merkle_manifest, op13_bpe]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
