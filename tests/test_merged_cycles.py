"""Components by merged cycles in packed form against plain reachability, and what their steps shuffle."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillstone.operators import graph


def by_hand(n, pairs):
    after = {i: set() for i in range(n)}
    for a, b in pairs:
        after[a].add(b)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for x in after[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    all_ = [reach(i) for i in range(n)]
    return [min(j for j in all_[i] if i in all_[j]) for i in range(n)]


@pytest.mark.parametrize(("rounds", "gap", "outside", "n"), [(24, 1, False, 1500), (1, 10, False, 48), (24, 1, True, 48)])
def test_components_and_the_links_between_them(spark, monkeypatch, rounds, gap, outside, n):
    """Also where passes stop before they end, ids have gaps, or a link leads to what is no vertex."""
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    rng, part = random.Random(rounds * gap), n // 5  # 1,500 are two runs of vertices
    pairs = {tuple(sorted(p)) if p[0] // part != p[1] // part else p for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(7 * n // 3))} | {(7, 7)}
    pairs |= {(b + i, b + (i + 1) % (part // 3)) for b in (0, part, 3 * part) for i in range(part // 3)}
    want = by_hand(n, pairs)
    rows = [(gap * a, gap * b) for a, b in pairs] * 2 + ([(3, 10**6)] if outside else [])
    with graph.dealt(spark.createDataFrame([(gap * i,) for i in range(n)], "id long"), spark.createDataFrame(rows, "src long, dst long").repartition(3)) as g:
        assert g.whole != outside
        parts, short = graph.components(g)
        got = {r.id: r.component for r in parts.collect()}
        degrees = {r.id: (r.in_degree, r.out_degree) for r in g.degrees.collect()}
    assert got == {gap * i: gap * c for i, c in enumerate(want)}
    between = {(got[s], got[d]) for s, d in ((r.src, r.dst) for r in short.collect()) if s in got and d in got and got[s] != got[d]}
    assert between == {(gap * want[a], gap * want[b]) for a, b in pairs if want[a] != want[b]}
    plain = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(spark.createDataFrame([(gap * i,) for i in range(n)], "id long"), spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert degrees == plain


def test_joins_over_edges_only_get_what_merged_cycles_leave(spark, monkeypatch):
    """Before, every round joined all edges (here 12,000)."""
    sizes, by_colours = [], graph._by_colours
    monkeypatch.setattr(graph, "_by_colours", lambda v, e: sizes.append(e.count()) or by_colours(v, e))
    rng = random.Random(5)
    pairs = [(a, b) for a, b in ((rng.randrange(2000), rng.randrange(2000)) for _ in range(12_000)) if a // 1000 <= b // 1000]
    parts = graph.scc(spark.range(2000), spark.createDataFrame(pairs, "src long, dst long"))
    assert parts.count() == 2000 and len(sizes) == 1 and sizes[0] < 100


def test_cycles_in_chains_are_merged_where_links_lead_to_near_vertices(spark, monkeypatch):
    """Before, a first pass that merged none was the last, and joins got all links (here 26,880 or so)."""
    sizes, by_colours = [], graph._by_colours
    monkeypatch.setattr(graph, "_by_colours", lambda v, e: sizes.append(e.count()) or by_colours(v, e))
    n, ring = 20_480, 64
    pairs = [(i, i // ring * ring + (i + 1) % ring) for i in range(n)] + [(i, i + ring) for i in range(0, n, 3) if i // ring % 4 < 3]
    with graph.dealt(spark.range(n), spark.createDataFrame(pairs, "src long, dst long")) as g:
        assert g.homes is not None and g.routes.where("NOT is_in").count() < 40
        parts, _ = graph.components(g)
        assert {r.id: r.component for r in parts.collect()} == {i: i // ring * ring for i in range(n)} and max(sizes) < 300
        outs = dict.fromkeys(range(n), 0)
        for a, _ in pairs:
            outs[a] += 1
        src, dst = (np.array(x) for x in zip(*pairs, strict=True))
        share = 1 / np.array([outs[i] for i in range(n)])
        rank = np.full(n, 1 / n)
        for _ in range(6):
            rank = 0.15 / n + np.bincount(dst, weights=(rank * share)[src], minlength=n)
        got = {r.id: r.page_rank for r in graph.pagerank(spark.range(n), g.edges, 6, None, digits=15, graph=g).collect()}
    assert max(abs(got[i] - rank[i]) for i in range(n)) < 1e-13
