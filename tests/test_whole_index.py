"""Indexes of all texts, by small batches."""

from __future__ import annotations

import pyarrow as pa

from quillstone.operators import search
from quillstone.plans.queries import QUERIES

TEXTS = [(1, "token " * 900), (2, "the token\0"), (3, "x" * 5001 + " config"), (4, "token\nthe config")]


def test_long_lines_and_binary_texts_are_indexed(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "big token", 2)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r.token, r.path): r["count"] for r in QUERIES["token_index"](spark, str(tmp_path)).collect()}
    assert found == {("token", "s/doc1.md"): 900, ("the", "s/doc2.md"): 1, ("token", "s/doc2.md"): 1, ("x" * 5001, "s/doc3.md"): 1, ("config", "s/doc3.md"): 1, ("token", "s/doc4.md"): 1, ("the", "s/doc4.md"): 1, ("config", "s/doc4.md"): 1}
    assert {r.token: r.n for r in QUERIES["token_top"](spark, str(tmp_path)).collect()} == {"token": 902, "the": 2, "config": 2, "x" * 5001: 1}
    assert {(r.token, r.path) for r in QUERIES["stored_index"](spark, str(tmp_path)).collect()} == {k for k in found if k[0] in ("token", "the", "config")}
    assert {r.path: "content" in r.match_kinds for r in QUERIES["keyword_search"](spark, str(tmp_path)).collect()} == {f"s/doc{i}.md": True for i in range(1, 5)}
    assert {r.path for r in QUERIES["search_previews"](spark, str(tmp_path)).collect()} == {"s/doc1.md", "s/doc2.md", "s/doc4.md"}


def test_postings_leave_a_task_in_small_batches():
    texts = [" ".join(f"word{i}x{k}" for k in range(1000)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(200))), pa.array(texts)], ["path", "text"])
    out = list(search._count(iter([batch]), None))
    assert max(map(len, out)) < 2 * search.POSTINGS_AT_ONCE and len(out) > 5
    assert sum(map(len, out)) == 200 * 1000 and {p for b in out for p in b.column(1).to_pylist()} == set(map(str, range(200)))
    assert not list(search._count(iter([batch.slice(0, 0)]), None))
