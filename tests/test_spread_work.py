"""Work that must not end up in one task or at the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph, privacy, resolve
from quillstone.plans import base


def test_texts_of_one_row_group_are_dealt_over_all_cores(spark):
    texts = base.sources(spark, "/root/testdata/sf0.001", base.MODULES)
    assert texts.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_components_are_joined_without_broadcasts(spark, monkeypatch):
    plans, kept = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    vertices, edges = spark.range(40), spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)] + [(20, 21), (21, 20), (22, 3)], "src long, dst long")
    parts = {r.id: r.component for r in graph.scc(vertices, edges).collect()}
    assert parts == {i: 0 if i < 20 else 20 if i < 22 else i for i in range(40)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_an_unchanged_text_takes_no_second_pass(spark):
    files = spark.createDataFrame([("plain",), ("key = abcdefgh12345",)], "text string")
    plan = privacy.unstable(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(split(text") <= 1 and privacy.unstable(files).count() == 0


def test_imports_that_ask_for_the_same_are_answered_once(spark, monkeypatch):
    sizes, kept = [], resolve.keep
    monkeypatch.setattr(resolve, "keep", lambda df: sizes.append((df.columns, (k := kept(df)).count())) or k)
    files = spark.createDataFrame([(f"src/m{i}.py",) for i in range(50)], "path string")
    imports = spark.range(50).select(F.col("id").alias("import_id"), F.concat(F.lit("src/m"), "id", F.lit(".py")).alias("path"), F.when(F.col("id") % 2 == 0, "os.path").otherwise(".m3").alias("specifier"))
    out = {r.import_id: (r.outcome, r.to_path, r.package) for r in resolve.resolve_python(imports, files, ["", "src"]).collect()}
    assert out == {i: ("edge", "src/m3.py", None) if i % 2 else ("stdlib", None, "os") for i in range(50)}
    assert [n for columns, n in sizes if "n" in columns and "starts" in columns] == [2]
