"""Running sums over hot keys, and streams that decide like the batch forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import privacy
from quillstone.sources.tables import running
from quillstone.streaming import limits


def events_of(spark, n, seed, keys=5, spread=3600):
    """Half of the rows have one key, some times recur; one key is null."""
    rng = random.Random(seed)
    rows = [(i, None if i % 97 == 5 else f"k{0 if rng.random() < 0.5 else rng.randrange(keys)}", rng.randrange(spread * 4) / 4, rng.random() < 0.05) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, s double, done boolean").withColumn("ts", F.timestamp_micros((1_700_000_000_000_000 + F.col("s") * 1_000_000).cast("long"))).drop("s")


def test_running_sums_of_a_hot_key_are_dealt_over_ranges(spark):
    df = events_of(spark, 4000, 1).withColumn("v", F.col("id") % 7)
    order = [F.desc("ts"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = running(df.repartition(5), "k", order, {"n": F.lit(1).cast("long"), "total": F.col("v")})
    want = df.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("v").over(w))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    part = df.repartitionByRange(8, "k", *order)
    most = part.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert df.where("k = 'k0'").count() > 2000 and most < 1000  # twice the mean at most
    assert running(df.limit(0), "k", order, {"n": F.lit(1)}).count() == 0


def test_offered_events_are_those_of_the_window(spark):
    df = events_of(spark, 3000, 2)
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)
    got = limits.offered(df, "k", "ts", 60)
    assert got.columns == [*df.columns, "n_offered"]
    assert {r.id: r.n_offered for r in got.collect()} == {r.id: r.n for r in df.withColumn("n", F.count("*").over(w)).collect()}


@pytest.mark.parametrize("gap", [2.5, 20])
def test_debounce_keeps_the_last_of_each_run(spark, gap):
    df = events_of(spark, 2000, 3)
    w = Window.partitionBy("k").orderBy("ts", "id")
    after = F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")
    want = df.withColumn("after", after).where(F.col("after").isNull() | (F.col("after") >= int(gap * 1_000_000)))
    got = limits.debounce(df, "k", "ts", "id", gap)
    assert got.columns == df.columns and {r.id for r in got.collect()} == {r.id for r in want.collect()}
    assert limits.debounce(df, "k", "ts", "id", 0).count() == df.count()


def test_budgets_large_and_small(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("aaab"), i, rng.randrange(9)) for i in range(800)], "k string, o long, size long")
    for most, most_bytes in ((24, 10**9), (24, 60), (200, 500)):
        want = set()
        for k in "ab":
            n = total = 0
            for r in df.where(F.col("k") == k).orderBy(F.desc("o")).collect():
                n, total = n + 1, total + r["size"]
                if n > most or total > most_bytes:
                    break
                want.add((k, r.o, n, total))
        for few in (1000, 0):
            monkeypatch.setattr(privacy, "FEW", few)
            got = privacy.within_budget(df, "k", [F.desc("o")], "size", most, most_bytes)
            assert {(r.k, r.o, r.place, r.bytes_so_far) for r in got.collect()} == want
    plan = privacy.within_budget(df.repartition(4), "k", [F.desc("o")], "size")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(privacy, "FEW", 1000)
    plan = privacy.within_budget(df.repartition(4), "k", [F.desc("o")], "size")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def streamed(spark, tmp_path, df, make):
    """Rows of a stream over df's rows, dealt at random over micro-batches that come one by one; two later events of a
    key of their own bring the watermark past all others."""
    rows = df.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)).cast("int"))
    late = [df.limit(1).withColumn("id", F.lit(-b).cast("long")).withColumn("k", F.lit("end")).withColumn("ts", F.expr(f"timestamp'2024-01-0{b} 00:00:00'")) for b in (1, 2)]
    folder = str(tmp_path / "in")
    for i, part in enumerate([*(rows.where(F.col("batch") == b).drop("batch") for b in range(5)), *late]):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    for i in range(7):  # in this order
        for at in (tmp_path / "in" / str(i)).glob("*.parquet"):
            target = tmp_path / "flat" / f"{i}.parquet"
            target.parent.mkdir(exist_ok=True)
            target.write_bytes(at.read_bytes())
            import os

            os.utime(target, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    name = "s" + "".join(random.choices("abcdefgh", k=8))
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).where("k <> 'end'").collect()


def test_throttled_streams_decide_like_the_batch(rocks, tmp_path):
    df = events_of(rocks, 300, 6).where("k IS NOT NULL").cache()
    got = streamed(rocks, tmp_path, df, lambda s: limits.throttle_stream(s, "k", "ts", "id", 30, "done", late="2 hours"))
    want = {r.id: r.admitted for r in limits.throttle(df, "k", "ts", "id", 30, "done").collect()}
    assert {r.id: r.admitted for r in got} == want and len(got) == df.count()


def test_debounced_streams_decide_like_the_batch(rocks, tmp_path):
    df = events_of(rocks, 300, 7).where("k IS NOT NULL").cache()
    got = streamed(rocks, tmp_path, df, lambda s: limits.debounce_stream(s, "k", "ts", "id", 25, late="2 hours"))
    want = {(r.k, r.id, r.ts) for r in limits.debounce(df, "k", "ts", "id", 25).collect()}
    assert {(r.k, r.id, r.ts) for r in got} == want and len(got) == len(want)


def test_throttled_streams_in_small_steps(rocks, tmp_path):
    """A short delay: most events are decided, and most state goes, long before the end."""
    df = events_of(rocks, 300, 8).where("k IS NOT NULL")
    df = df.withColumn("ts", F.expr("timestamp_seconds(1700000000 + id * 10)")).cache()
    rows = [df.where(F.col("id").between(60 * i, 60 * i + 59)) for i in range(5)]
    (tmp_path / "flat").mkdir()
    for i, part in enumerate(rows):
        part.toPandas().astype({"ts": "datetime64[us]"}).sample(frac=1, random_state=i).to_parquet(tmp_path / "flat" / f"{i}.parquet", index=False)
    stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    q = limits.throttle_stream(stream, "k", "ts", "id", 30, late="1 second").writeStream.outputMode("append").format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        progress = [p for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    got = {r.id: r.admitted for r in rocks.table("steps").collect()}
    want = {r.id: r.admitted for r in limits.throttle(df, "k", "ts", "id", 30).collect()}
    assert all(want[i] == v for i, v in got.items()) and len(got) > 290 and len(progress) >= 5
