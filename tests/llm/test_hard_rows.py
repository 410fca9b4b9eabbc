"""Repeated and null ids, hot groups, very long texts, and the power of the statistics behind the operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_hits, check_packing, documents, library, prose, texts

from quillstone.llm import decontam, kernels, linedup, neardup, packing, quality, shared, tokens
from quillstone.sources import tables
from quillstone.llm.queries import tokenizer_path


def test_rejected_rows_go_by_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, "a"), (3, None)], "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("__id", F.lit(0))
    gone = spark.createDataFrame([(1, "a"), (3, None)], "doc_id long, text string").withColumn("fp", shared.fingerprint("text"))
    out = shared.without(docs, gone)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "a"), (1, "b"), (2, "a")]


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a, "en"), (1, a, "de"), (1, a, None), (1, b, "en"), (2, a, "en"), (3, b, "en"), (None, a, "en"), (4, "", "en"), (4, None, "en"), (5, a + " x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = neardup.near_duplicates(docs)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (None, None)}
    left = sorted(neardup.one_of_each(docs, found).collect(), key=repr)
    assert left == sorted([r for r in docs.collect() if r.doc_id in (None, 4)] + [r for r in docs.collect() if (r.doc_id, r.text, r.lang) in ((1, a, None), (1, b, "en"))], key=repr)


def test_large_mixed_groups_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 12)
    rng = random.Random(12)
    values = []
    for base in range(4):
        w = prose(rng, 120).split()
        for _ in range(45):
            v = list(w)
            for _ in range(rng.randrange(0, 9)):
                v[rng.randrange(len(v))] = f"new{base}{rng.randrange(10**6)}"
            values.append(" ".join(v))
    out = neardup.near_duplicates(documents(spark, values), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(values, 4, 80)


def test_recall_of_bands_at_the_threshold():
    rng = np.random.default_rng(3)
    circle, found, n = neardup.Circulant(neardup.BANDS * neardup.ROWS), 0, 1000
    for _ in range(n):
        x = rng.integers(0, 1 << 63, 225, dtype=np.uint64)
        a, b = x[:200], np.concatenate([x[:178], x[203:]])  # 178 of 222: just over 0.8
        assert 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.81
        found += bool((circle.bands(a, neardup.BANDS, neardup.ROWS) == circle.bands(b, neardup.BANDS, neardup.ROWS)).any())
    assert found >= n - 1


def test_certified_cutoffs_reject_documents(spark):
    rng = random.Random(7)
    clean = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, clean(), "en") for i in range(450)] + [(i, clean().replace("w", "#$"), "en") for i in range(450, 500)] + [(i, clean(), None) for i in range(500, 520)]
    rows += [(600, clean(), "en"), (600, rows[470][1], "en"), (None, rows[460][1], "en")]
    labels = spark.createDataFrame([(i, int(i < 450)) for i in range(500)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.quality(docs, labels)
    assert {(r.doc_id, r.text) for r in shared.without(docs, out.where("NOT kept")).collect()} == {(i, t) for i, t, _ in rows if "#" not in t}
    fewer = quality.quality(docs, labels.where("doc_id > 160"))  # 289 good labels certify nothing, 299 are needed
    assert fewer.where("NOT kept").count() == 0


def test_very_long_texts(spark):
    """Texts beyond a block, one without any place to cut, and shorter ones around them."""
    rng = random.Random(4)
    long_ = " ".join(prose(rng, 500) + "\n" for _ in range(260))
    assert len(long_.encode()) > 1.5 * kernels.BLOCK_BYTES
    values = [long_, "short text", long_ + " end", None, "q" * 50_000, long_[: 1 << 19], texts()[3]]
    docs, model = documents(spark, values).coalesce(1), library()
    ids = [model.encode(t or "", add_special_tokens=False).ids for t in values]
    assert [r.n_tokens for r in tokens.token_counts(docs, tokenizer_path()).orderBy("doc_id").collect()] == list(map(len, ids))
    check_packing(packing.with_digest(packing.pack(docs, tokenizer_path())).collect(), values)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(values, 5, 80)
    items = [(0, " ".join(long_.split()[70_000:70_014])), (1, " ".join(long_.split()[-13:]))]
    hits = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert hits == brute_hits(values, items, 10) and hits[0][2] == ["0", "1"]
    removed = {r.doc_id: (r.n_lines, len(r.removed)) for r in linedup.line_overlaps(docs).collect()}
    assert removed[0] == (261, 0) and removed[2] == (261, 260)
    counts = {r.doc_id: (r.n_words, r.n_lines) for r in quality.features(docs).collect()}
    assert counts[0] == (len(long_.split()), 260) and counts[4] == (1, 1)


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert shared.sized(wide, width=F.octet_length("t"), most_bytes=50_000) is wide and shared.sized(wide, rows=50) is wide


@pytest.mark.parametrize("parts", [2, 20_000])
def test_hot_keys_are_joined_alike(spark, parts):
    rows = spark.range(1000).select((F.col("id") % 7 * F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5").cache()
    assert sorted(shared.join_hot(rows, side, "k", "n", parts).collect()) == sorted(rows.join(side, "k").collect())


def test_a_large_benchmark_is_joined_by_shares(spark, monkeypatch):
    """Windows too many to be broadcast; one short item's word is in all documents many times."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    values = [" ".join(["the"] * 40 + [rng.choice(words) for _ in range(30)]) for _ in range(60)] + [None, "", "the"]
    items = [(0, "the"), (1, values[7][-60:]), (2, "the w1"), (3, "w2 the"), *((10 + i, " ".join(values[i].split()[45:57])) for i in range(0, 60, 7))]
    want = brute_hits(values, items, 10)
    for rows, occurrences in ((10**6, 1 << 16), (0, 50), (0, 1 << 16)):
        monkeypatch.setattr(tables, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontam, "OCCURRENCES", occurrences)
        out = decontam.contamination(documents(spark, values), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in out} == want
    assert [decontam.filter_bits(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 40)] == [24, 24, 25, 30]
