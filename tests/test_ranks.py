"""Ranks by packed waves against plain iteration."""

from __future__ import annotations

import glob
import random

import numpy as np
import pytest

from quillstone.functions import constants as C
from quillstone.operators import graph


def plain(n, edges, rounds, epsilon):
    outs = np.zeros(n)
    src, dst = map(np.array, zip(*edges, strict=True))
    np.add.at(outs, src, 1)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - C.DAMPING) / n + C.DAMPING * rank[outs == 0].sum() / n + np.bincount(dst, weights=rank[src] / outs[src], minlength=n)
        gone = np.abs(new - rank).sum()
        rank = new
        if epsilon is not None and gone < epsilon:
            break
    return rank


@pytest.mark.parametrize("kind", ["mixing", "acyclic"])
def test_waves_that_settled_are_not_computed_again(spark, monkeypatch, kind):
    rng, n = random.Random(kind), 3000
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(40_000)) if a != b}
    if kind == "acyclic":
        pairs = {(min(p), max(p)) for p in pairs}
    pairs = sorted(pairs)
    folders, fresh = [], graph.fresh_path
    monkeypatch.setattr(graph, "fresh_path", lambda s: folders.append(fresh(s)) or folders[-1])
    vertices, edges = spark.createDataFrame([(10 * i,) for i in range(n)], "id long"), spark.createDataFrame([(10 * a, 10 * b) for a, b in pairs], "src long, dst long")
    epsilon = 1e-6 if kind == "acyclic" else None
    got = {r.id // 10: r.page_rank for r in graph.pagerank(vertices, edges, 100, epsilon, digits=15).collect()}
    want = plain(n, pairs, 100, epsilon)
    assert len(got) == n and max(abs(got[i] - want[i]) for i in range(n)) < 1e-13
    if kind == "mixing":
        assert all(len(glob.glob(f"{f}/k=*")) < 60 for f in folders)
    assert graph.pagerank(vertices.limit(0), edges).count() == 0
