"""Rows replaced in place, and joins that leave a stored version where it is."""

from __future__ import annotations

import os
import random

from quillstone.sources.store import KeyedStore, StoredVersion


def files_by_folder(folder):
    return {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("bucket=")}


def test_only_folders_of_replaced_keys_are_written(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "store")
    rows = {(f"p{i}", j): rng.randrange(100) for i in range(60) for j in range(rng.randrange(1, 4))}
    df = lambda d: spark.createDataFrame([(k, j, v) for (k, j), v in d.items()], "path string, n int, v int")
    store = KeyedStore(spark, folder, "path", 16)
    store.create(df(rows | {(None, 0): 5}))
    read = lambda: {(r.path, r.n): r.v for r in store.read().collect()}
    assert read() == rows and len(files_by_folder(folder)) == 16
    for new, gone in (({("p3", 0): -1, ("p3", 7): -2}, None), ({}, ["p5", "p9", "nowhere"]), ({("new", 1): 4, ("p9", 2): 8}, ["p9", "p11"]), ({}, [])):
        before = files_by_folder(folder)
        keys = spark.createDataFrame([(k,) for k in gone], "path string") if gone is not None else None
        written = store.replace(df(new), keys)
        out = {*(k for k, _ in new), *(gone or [])}
        rows = {k: v for k, v in rows.items() if k[0] not in out} | new
        after = files_by_folder(folder)
        assert read() == rows and len(written) <= len(out)
        assert {d for d in after if after[d] != before[d]} == {f"bucket={b}" for b in written}
    everything = sorted({k for k, _ in rows})
    store.replace(df({}), spark.createDataFrame([(k,) for k in everything], "path string"))
    assert read() == {} and len(files_by_folder(folder)) == 16


def test_a_stored_version_is_not_shuffled(spark, tmp_path):
    old = spark.createDataFrame([(f"p{i}", None if i == 4 else f"h{i % 5}") for i in range(300)], "path string, hash string")
    now = spark.createDataFrame([(f"p{i}", None if i == 4 else f"h{i % 5}" if i % 3 else "new") for i in range(100, 400)] + [("p4", None), ("p5", None), (None, "h1")], "path string, hash string")
    version = StoredVersion(spark, str(tmp_path / "version"), ["path"], 8)
    version.save(old)
    hits, misses, gone = version.split(now, "hash")
    want = {r.path: r.hash for r in old.collect()}
    assert {r.path for r in hits.collect()} == {r.path for r in now.collect() if r.path in want and want[r.path] == r.hash}
    assert {r.path for r in misses.collect()} == {r.path for r in now.collect() if r.path not in want or want[r.path] != r.hash}
    assert {r.path for r in gone.collect()} == want.keys() - {r.path for r in now.collect()}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in version.split(now, "hash"):
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" in plan
            scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
            assert "Bucketed: true" in scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
