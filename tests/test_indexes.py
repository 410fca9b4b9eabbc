"""Indexes on storage: segments kept up to date, and names by literal parts."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import search
from quillstone.sources.index import PostingIndex, changed_rows, gram_postings, names_with, save_grams


def rows_of(df):
    return sorted((r.token, r.path, r["count"], tuple(r.lines)) for r in df.collect())


def files_of(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "path string, text string")


def listed(folder):
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names}


def test_an_index_is_kept_up_to_date(spark, tmp_path):
    rng = random.Random(8)
    make = lambda: " ".join(rng.choice(["alpha", "betaGamma", "x_yz", "delta", "the", "q"]) + str(rng.randrange(30)) for _ in range(40))
    texts = {f"d/{i}.py": make() for i in range(200)} | {"none": None, "empty": ""}
    index = PostingIndex(spark, f"{tmp_path}/index", buckets=4)
    index.create(search.postings(files_of(spark, texts)))
    for change in range(3):
        before = listed(f"{tmp_path}/index")
        new = dict(texts)
        for k in rng.sample(sorted(texts), 4):  # 2 %
            new[k] = make()
        del new[f"d/{10 + change}.py"]
        new[f"new/{change}"] = make()
        if change:
            new["d/10.py"] = make()  # a path that was gone comes back
        hashed = [files_of(spark, t).withColumn("hash", F.xxhash64("text")) for t in (texts, new)]
        changed, moved = changed_rows(*hashed, "path", "hash")
        assert changed.count() <= 6 and moved.count() <= 7
        assert {r.path for r in changed.collect()} == {k for k in new if k not in texts or new[k] != texts[k]}
        index.update(search.postings(changed), moved)
        assert {k: v for k, v in listed(f"{tmp_path}/index").items() if k in before} == before  # nothing is written again
        texts = new
        assert rows_of(index.read()) == rows_of(search.postings(files_of(spark, texts)))
        some = ["alpha3", "betagamma7", "beta", "nope"]
        assert rows_of(index.read(some)) == rows_of(search.postings(files_of(spark, texts), some))
    index.compact()
    assert rows_of(index.read()) == rows_of(search.postings(files_of(spark, texts)))
    plan = index.read(["alpha3"])._jdf.queryExecution().toString()
    assert "Join" not in plan and "PushedFilters: [In(token" in plan or "EqualTo(token" in plan
    index.update(search.postings(files_of(spark, {"none": "zeta9"})), spark.createDataFrame([("none",)], "path string"))
    texts["none"] = "zeta9"
    assert rows_of(index.read()) == rows_of(search.postings(files_of(spark, texts)))


def test_a_write_that_failed_does_not_count(spark, tmp_path):
    index = PostingIndex(spark, f"{tmp_path}/index", buckets=2)
    index.create(search.postings(files_of(spark, {"a": "one two", "b": "two"})))
    want = rows_of(index.read())
    broken = search.postings(files_of(spark, {"a": "three"}))
    broken.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/index/postings/segment=1")  # no entry in the log
    assert rows_of(index.read()) == want
    index.update(search.postings(files_of(spark, {"a": "four"})), spark.createDataFrame([("a",)], "path string"))
    assert rows_of(index.read()) == rows_of(search.postings(files_of(spark, {"a": "four", "b": "two"})))


@pytest.mark.parametrize("seed", [1, 2])
def test_names_by_their_parts(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcé%_\\.中") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + ["", "a", "ab", "aaaaaa", None, "aaaa"]
    parts = [names[i][k : k + n] for i, k, n in ((1, 0, 3), (5, 1, 4), (9, 0, 9), (20, 2, 3))] + ["a", "é", "ab", "", "zzz", "a%", "aaa", "aaaa", "%_\\"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    save_grams(gram_postings(df), f"{tmp_path}/grams", buckets=8)
    got = sorted(tuple(r) for r in names_with(spark, f"{tmp_path}/grams", parts, buckets=8).collect())
    assert got == sorted((p, n) for p in set(parts) for n in {x for x in names if x is not None} if p in n)
    rare = names_with(spark, f"{tmp_path}/grams", ["aaaa"], buckets=8)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,aaa)" in rare and "PartitionFilters: [isnotnull(bucket" in rare
    assert names_with(spark, f"{tmp_path}/grams", []).count() == 0


def test_search_by_stored_names(spark, tmp_path):
    rng = random.Random(4)
    words = ["get", "config", "token", "load", "user", "x1"]
    files = spark.createDataFrame([(f"{rng.choice(['src', 'token', 'Lib'])}/{rng.choice(words)}{rng.choice(words)}{i}.py", rng.choice(["test", "docs"]), i / 60, " ".join(rng.choices(words, k=9))) for i in range(60)], "path string, classification string, importance double, text string")
    symbols = files.select("path", F.concat(F.lit("Get"), F.element_at(F.split("path", "/"), 2)).alias("name"), (F.col("importance") > 0.5).alias("is_exported"))
    save_grams(gram_postings(search.search_names(files, symbols)), f"{tmp_path}/names")
    for query in ("token config", "getuser x1", "load the", "zzz"):
        index = search.postings(files, list(search.term_weights(query)[0]))
        want = search.search(spark, files, symbols, index, query).collect()
        hits, dropped = search.answer(spark, files, symbols, index, query, grams=f"{tmp_path}/names")
        assert hits.collect() == want and dropped == (["x1"] if "x1" in query else [])
    hits, dropped = search.answer(spark, files, symbols, search.postings(files, []), "a of", grams=f"{tmp_path}/names")
    assert hits.count() == 0 and dropped == ["a", "of"]


def test_skip_rules_before_indexing(spark):
    rows = [("a", "plain"), ("b", None), ("c", "x\0y"), ("d", "z" * 30_000), ("e", ""), ("f", "w " * 2_000_000)]
    assert {r.path for r in search.indexable(spark.createDataFrame(rows, "path string, text string")).collect()} == {"a", "e"}
