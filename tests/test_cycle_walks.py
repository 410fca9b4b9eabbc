"""Walks through components of any size, and links that come batch by batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph


def brute_walk(members, out):
    """As the surveyed code builds it."""
    path, left = [], sorted(members)
    at = left[0]
    while True:
        path.append(at)
        left.remove(at)
        if not left:
            return path
        nexts = [n for n in out.get(at, ()) if n in left]
        at = min(nexts) if nexts else left[0]


def test_a_component_of_more_than_a_million_is_walked(spark):
    n = 1_000_001
    e = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + n - 1) % n).alias("dst"))
    (row,) = graph.cycle_paths(spark.range(n).withColumn("component", F.lit(0).cast("long")), e).collect()
    assert row.component == 0 and row.path == [0, *range(n - 1, 0, -1)]


@pytest.mark.parametrize("named", [False, True])
def test_walks_match_brute_force_over_many_batches(spark, named):
    """Of integers and names: small components, vertices by themselves, and one with a vertex of many links and dead ends."""
    rng = random.Random(5)
    vertices = [f"é{i}" if named else i for i in range(600)]
    groups = [vertices[:150], *(vertices[i : i + 3] for i in range(150, 450, 3))]  # and 150 by themselves
    edges = [(a, b) for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)] + [(vertices[7], v) for v in vertices] + [(v, vertices[7]) for v in vertices[:150]]
    edges += [(rng.choice(vertices[:150]), rng.choice(vertices)) for _ in range(300)] + edges[:50] + [(v, v) for v in vertices[::4]]
    of = {v: min(g) for g in groups for v in g}
    kind, out = "string" if named else "long", {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    parts = spark.createDataFrame([(v, of.get(v, v)) for v in vertices], f"id {kind}, component {kind}")
    e = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    want = {min(g): brute_walk(g, {a: b & set(g) for a, b in out.items()}) for g in groups}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert {r.component: r.path for r in graph.cycle_paths(parts, e).collect()} == want
            some = {r.component: r.path for r in graph.cycle_paths(parts, e, largest=3).collect()}
            assert some == {c: p if len(p) <= 3 else None for c, p in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
