"""Every stage takes effect on its own input, keeps the columns, and gives what brute force gives."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from test_llm_operators import brute_components, brute_hits, check_packing

import __spark_entry__

SF = "/root/testdata/sf0.001"


def base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.keep(out)
        after = {r.doc_id: r.text for r in docs.collect()}
        ids = list(before)
        if name == "quality_rules":  # so few labels certify no cutoff
            assert set(after) == {i for i, t in before.items() if not base_failed(t)} and len(after) < len(before)
        elif name == "line_dedup":
            assert set(after) == set(before)
            words = lambda line: b" ".join(line.encode().lower().split())
            earlier: set[bytes] = set()
            changed = 0
            for i in sorted(ids):
                old, new = before[i].split("\n"), after[i].split("\n")
                gone = Counter(map(words, old)) - Counter(map(words, new))
                assert all(not line or line in earlier for line in gone), i  # only lines of earlier documents go
                changed += bool(gone)
                earlier |= set(map(words, old))
            assert changed
        elif name == "minhash_near_dedup":
            want = brute_components([before[i] for i in sorted(ids)], 5, 80)
            assert sorted(after) == [i for k, i in enumerate(sorted(ids)) if want[k][2]]
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = brute_hits([before[i] for i in ids], items, 10)
            assert set(after) == {i for k, i in enumerate(ids) if not want[k][3]} and len(after) < len(before)
        before = after
    ids = sorted(before)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    place = {i: k for k, i in enumerate(ids)}
    renamed = [type("Piece", (), r.asDict() | {"doc_id": place[r.doc_id]}) for r in rows]
    check_packing(renamed, [before[i] for i in ids])


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
