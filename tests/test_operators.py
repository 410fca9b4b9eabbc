from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph as G
from quillstone.operators import parse, privacy, search, structure
from quillstone.sources import files as S
from quillstone.sources.tables import keep
from quillstone.streaming import limits


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def vertices_of(spark, n):
    return spark.range(n).toDF("id")


def test_degrees_collapse_repeats_and_self_edges(spark):
    got = {r.id: (r.in_degree, r.out_degree) for r in G.degrees(vertices_of(spark, 3), edges_of(spark, [(0, 1), (0, 1), (2, 2)])).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 0)}
    assert [r.id for r in G.orphans(vertices_of(spark, 3), edges_of(spark, [(0, 1), (2, 2)])).collect()] == [2]


def brute_pagerank(n, edges, iterations, epsilon):
    out = {i: sorted({b for a, b in edges if a == i and a != b}) for i in range(n)}
    r = {i: 1 / n for i in range(n)}
    for _ in range(iterations):
        dangling = sum(r[i] for i in r if not out[i])
        new = {i: 0.15 / n + 0.85 * dangling / n for i in r}
        for i in r:
            for j in out[i]:
                new[j] += r[i] / len(out[i])
        moved = sum(abs(new[i] - r[i]) for i in r)
        r = new
        if epsilon is not None and moved < epsilon:
            break
    return r


@pytest.mark.parametrize(("pairs", "iterations", "epsilon"), [([(0, 1), (1, 2), (2, 0), (3, 0), (0, 1), (4, 4)], 6, None), ([(0, 1), (1, 2), (3, 2)], 12, 1e-2), ([], 5, 1e-6)])
def test_pagerank_with_undamped_shares(spark, pairs, iterations, epsilon):
    got = {r.id: r.page_rank for r in G.pagerank(vertices_of(spark, 5), edges_of(spark, pairs), iterations, epsilon).collect()}
    assert got == pytest.approx(brute_pagerank(5, pairs, iterations, epsilon), abs=2e-6)


def test_strong_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(18), rng.randrange(18)) for _ in range(24)]
    reach = {i: {i} for i in range(18)}
    for _ in range(18):
        for a, b in pairs:
            for i in reach:
                if a in reach[i]:
                    reach[i].add(b)
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in reach}
    parts = G.scc(vertices_of(spark, 18), edges_of(spark, pairs))
    assert {r.id: r.component for r in parts.collect()} == want


def test_cycles_by_edges(spark):
    e = edges_of(spark, [(0, 1), (1, 0), (2, 3), (3, 4), (4, 2), (4, 5)])
    got = [(r.cycle_rank, r.component, r.size, r.edge_count) for r in G.cycles(G.scc(vertices_of(spark, 6), e), e).orderBy("cycle_rank").collect()]
    assert got == [(1, 2, 3, 3), (2, 0, 2, 2)]


def test_layers_are_shortest_and_pooled(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 0)])
    got = {r.id: r.layer for r in G.bfs_layers(spark.createDataFrame([(0,)], "id long"), e, 3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}


def test_roadmap_of_a_cycle_has_one_step_with_companions(spark):
    rows = [(0, "src/a.ts", "entrypoint", 0.5, 1), (1, "src/b.ts", "unknown", 0.4, 1), (2, "src/c.ts", "unknown", 0.3, 1), (3, "src/utils/d.ts", "util", 0.2, 0), (4, "x.ts", "unknown", 0.1, 0)]
    f = spark.createDataFrame(rows, "id long, path string, classification string, importance double, in_degree long")
    out = G.roadmap(f, spark.createDataFrame([(0, 1)], "id long, rank int"), edges_of(spark, [(0, 1), (1, 2), (2, 0), (1, 3)])).orderBy("order").collect()
    assert [(r.id, r.section, r.n_companions) for r in out] == [(0, "entry", 2), (3, "leaf-utility", 0), (4, "unreached", 0)]
    assert out[0].depends_on == [1] and out[1].previous == 0


def test_ranks_over_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 101).alias("v")).repartition(7)
    got = {r.id: r["rank"] for r in G.rank_rows(df, [F.desc("v"), F.col("id")]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i * 7919 % 101), i))
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_resolution(spark):
    existing = spark.createDataFrame([("a/b.ts",), ("a/b/index.ts",), ("a/c.tsx",), ("a/c.js",)], "path string")
    imports = spark.createDataFrame([(1, "a/b"), (2, "a/c"), (3, "a/d"), (4, "a/b.ts")], "import_id long, base string")
    assert {r.import_id: r.to_path for r in structure.probe(imports, existing).collect()} == {1: "a/b.ts", 2: "a/c.tsx", 3: None, 4: "a/b.ts"}
    configs = spark.createDataFrame([("", "root"), ("a/b", "near")], "dir string, config string")
    files = spark.createDataFrame([("a/b/c/x.ts",), ("a/x.ts",)], "path string")
    assert {r.path: r.config for r in structure.nearest_ancestor(files, configs).collect()} == {"a/b/c/x.ts": "near", "a/x.ts": "root"}


def test_incremental_steps(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "path string, content_hash string")
    assert [r.path for r in structure.changed(cur, old).orderBy("path").collect()] == ["b", "c"]
    assert [r.path for r in structure.vanished(cur, old).collect()] == ["z"]
    assert {tuple(r) for r in structure.upsert(old, cur, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("z", "0")}
    one, two = structure.fingerprint(cur).first(), structure.fingerprint(cur.repartition(5)).first()
    assert one == two and structure.fingerprint(old).first() != one


def test_search_scores(spark):
    files = spark.createDataFrame([("src/auth.ts", "unknown", 0.0), ("tests/auth.test.ts", "test", 0.0), ("x.ts", "unknown", 1.0)], "path string, classification string, importance double")
    symbols = spark.createDataFrame([("src/auth.ts", "auth", True), ("x.ts", "authorName", False)], "path string, name string, is_exported boolean")
    index = search.postings(spark.createDataFrame([("src/auth.ts", "auth auth\nauth"), ("x.ts", "nothing")], "path string, text string"))
    got = {r.path: r for r in search.search(spark, files, symbols, index, "auth db", keywords={}).collect()}
    assert got["src/auth.ts"].score == pytest.approx(108 + 45 + 8) and got["src/auth.ts"].match_kinds == ["symbol-exact", "filename-exact", "content"]
    assert got["x.ts"].score == pytest.approx(60 + 25) and got["x.ts"].best_symbol == "authorName"
    assert got["tests/auth.test.ts"].score == 0.0
    assert search.term_weights("db go") == ({}, ["db", "go"])


def test_postings_cap_lines(spark):
    r = search.postings(spark.createDataFrame([("p", "\n".join(["token"] * 30))], "path string, text string")).first()
    assert (r.token, r["count"], r.lines) == ("token", 30, list(range(1, 21)))


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("k", 1, 50_000), ("k", 2, 50_000), ("k", 3, 10)], "k string, o int, size long")
    assert [r.o for r in privacy.within_budget(df, "k", ["o"], "size").collect()] == [1]


def test_citations(spark):
    index = spark.createDataFrame([("a/b.ts", 10)], "path string, line_count long")
    answers = spark.createDataFrame([(1, "see `./a/b.ts:10`"), (2, "see `a/b.ts:11`"), (3, "none"), (4, "`a/b.ts` and `c.ts:1`"), (5, "`a/b.ts:1` [[x]]")], "id long, text string")
    assert {r.id: r.is_valid for r in privacy.verified(answers, index, "id").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_admission_depends_on_admissions(spark):
    df = spark.createDataFrame([(i, "u", i * 10) for i in range(12)] + [(100, "v", 0)], "id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.admitted for r in limits.admit(df, "user", "ts", "id", limit=2, window_s=60).collect()}
    assert [i for i in range(12) if got[i]] == [0, 1, 6, 7] and got[100]
    some = {r.id for r in limits.throttle(df, "user", "ts", "id", gap_s=25).collect() if r.admitted}
    assert some == {0, 3, 6, 9, 100}
    assert {r.id for r in limits.debounce(df, "user", "ts", "id", 5).collect()} == set(range(12)) | {100}


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, i % 3, "ab"[i % 2], float(i), 1_700_000_000 + i * 60) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, limits.windowed_counts(df).collect()))
    q = limits.admit_stream(stream, "user_id", "ts", "event_id", 2, 1200).writeStream.outputMode("append").format("memory").queryName("a").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.user_id, r.event_id, r.admitted) for r in limits.admit(df, "user_id", "ts", "event_id", 2, 1200).collect()}
    assert {(r.user_id, r.event_id, r.admitted) for r in spark.table("a").collect()} == want


def test_scan_and_manifests(spark, tmp_path):
    root = tmp_path / "repo"
    for path, content in {
        "src/a.ts": b"export const x = 1;\n",
        "node_modules/x/i.js": b"1",
        "bin.py": b"a\x00b",
        "bad.md": b"\xff\xfe",
        "package.json": json.dumps({"name": "n", "version": "1.0", "dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}}).encode(),
        "api/requirements.txt": b"# c\nFlask==2.0\nrequests>=2 ; x\n",
        "api/go.mod": b"module m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    files = S.read_text(S.scan_files(spark, str(root))).cache()
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"src/a.ts", "bin.py", "bad.md", "package.json", "api/requirements.txt", "api/go.mod"}
    assert got["bin.py"].skip_reason == "binary" and got["src/a.ts"].skip_reason is None and got["bad.md"].is_lossy
    deps = {(r.ecosystem, r.name, r.scope) for r in S.dependencies(files).collect()}
    assert deps == {("npm", "react", "runtime"), ("npm", "jest", "dev"), ("pypi", "flask", "runtime"), ("pypi", "requests", "runtime"), ("go", "github.com/a/b", "runtime")}
    assert {(r.path, r.project_name) for r in S.manifests(files).collect()} == {("package.json", "n"), ("api/requirements.txt", None), ("api/go.mod", "m")}
    scanned = S.scan_files(spark, str(root))
    assert S.file_slice(scanned, "src/a.ts", 6).first().asDict() == {"path": "src/a.ts", "text": "export", "is_truncated": True, "line_count": 1}
    assert S.file_slice(scanned, "../x", 6).count() == 0 and S.over_cap(scanned, 3)
    wanted = spark.createDataFrame([("src/a.ts",), ("nope",)], "path string")
    assert [r.path for r in S.missing_answers(S.snippets(scanned, wanted)).collect()] == ["nope"]


def test_nested_ignores_and_aliases(spark):
    files = spark.createDataFrame([("a/x.log",), ("a/keep/x.log",), ("b/x.log",)], "path string")
    rules = spark.createDataFrame([("", 0, r"\.log$", False), ("a/keep", 0, r"^x\.log$", True)], "dir string, seq int, regex string, negated boolean")
    assert {r.path for r in S.nested_ignores(files, rules).collect()} == {"a/keep/x.log"}
    configs = [("base.json", '{ // c\n "compilerOptions": {"paths": {"@/*": ["src/*"], "#x": ["y"],}}}'), ("web/tsconfig.json", '{"extends": "./mid.json", "compilerOptions": {"paths": {"#x": ["z"]}}}'), ("web/mid.json", '{"compilerOptions": {"paths": {"m/*": ["n/*"]}}}')]
    configs += [("tsconfig.json", '{"extends": "./base"}'), ("x/tsconfig.json", '{"compilerOptions": {"baseUrl": "../y"}}'), ("bad/tsconfig.json", "{")]
    found = S.tsconfigs(spark.createDataFrame(configs, "path string, text string")).cache()
    assert {(r.dir, r.base) for r in found.collect()} == {("web", "web"), ("", ""), ("x", "y"), ("bad", "bad")}
    got = {(r.dir, r.pattern): r.targets for r in S.path_patterns(found).collect()}
    assert got == {("web", "#x"): ["z"], ("web", "m/*"): ["n/*"], ("", "@/*"): ["src/*"], ("", "#x"): ["y"]}


def test_parsers(spark):
    py = "import os\nfrom . import x, y\nfrom a.b import *\nimportlib.import_module('dyn')\nMAX = 1\nclass K:\n    def m(self): pass\n\ndef _f():\n    pass\n"
    files = spark.createDataFrame([("a.py", py), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    assert {(r.name, r.kind, r.container_name) for r in parse.python_symbols(files).collect()} == {("MAX", "const", None), ("K", "class", None), ("m", "method", "K"), ("_f", "function", None)}
    assert {(r.specifier, r.kind) for r in parse.python_imports(files).collect()} == {("os", "static"), (".x", "static"), (".y", "static"), ("a.b", "static"), ("dyn", "dynamic")}
    assert [r.path for r in parse.parse_failures(files).collect()] == ["bad.py"]
    ts = "import type { T } from './t';\nimport React from 'react';\nexport * from './r';\nconst q = require('q');\nconst d = await import('./d');\nexport function useThing() {}\nexport const Panel = () => 1;\nexport interface I {}\nlet v = 2;\n"
    js = spark.createDataFrame([("a.tsx", ts)], "path string, text string")
    assert {(r.specifier, r.kind) for r in parse.script_imports(js).collect()} == {("./t", "type"), ("react", "static"), ("./r", "reexport"), ("q", "require"), ("./d", "dynamic")}
    assert {(r.name, r.kind) for r in parse.script_symbols(js).collect()} == {("q", "const"), ("d", "const"), ("useThing", "hook"), ("Panel", "component"), ("I", "component"), ("v", "variable")}  # in files that may hold JSX, types are named by the same rule


def test_resolution_tiers(spark):
    from quillstone.operators import resolve

    files = spark.createDataFrame([("src/a/x.ts",), ("src/a/y.ts",), ("src/b/index.ts",), ("packages/web/src/u.ts",)], "path string")
    imports = spark.createDataFrame([(1, "src/a/x.ts", "./y"), (2, "src/a/x.ts", "../b"), (3, "src/a/x.ts", "./nope"), (4, "src/a/x.ts", "@/b"), (5, "src/a/x.ts", "@/gone"), (6, "src/a/x.ts", "web/u"), (7, "src/a/x.ts", "@s/p/q"), (8, "src/a/x.ts", "react/jsx"), (9, "src/a/x.ts", ".")], "import_id long, path string, specifier string")
    configs = spark.createDataFrame([("", "")], "dir string, base string")
    patterns = spark.createDataFrame([("", "@/*", ["gone/*", "src/*"])], "dir string, pattern string, targets array<string>")
    packages = spark.createDataFrame([("web", "packages/web/src", None)], "name string, dir string, entry string")
    got = {r.import_id: (r.outcome, r.to_path or r.package or r.reason) for r in resolve.resolve(imports, files, configs, patterns, packages).collect()}
    assert got == {1: ("edge", "src/a/y.ts"), 2: ("edge", "src/b/index.ts"), 3: ("unresolved", "no-match-on-disk"), 4: ("edge", "src/b/index.ts"), 5: ("unresolved", "alias-unmapped"), 6: ("edge", "packages/web/src/u.ts"), 7: ("external", "@s/p"), 8: ("external", "react"), 9: ("external", ".")}


def test_python_resolution(spark):
    from quillstone.operators import resolve

    files = spark.createDataFrame([("app/main.py",), ("app/models/__init__.py",), ("app/models/user.py",), ("lib/tool.py",), ("ns/deep/x.py",)], "path string")
    rows = [(1, "app/main.py", ".models.user"), (2, "app/models/user.py", "..main"), (3, "app/main.py", "app.models.User"), (4, "app/main.py", "tool"), (5, "app/main.py", "os.path"), (6, "app/main.py", "requests.api"), (7, "app/main.py", ".gone"), (8, "app/main.py", "ns.deep"), (9, "app/models/user.py", ".")]
    got = {r.import_id: (r.outcome, r.to_path or r.package) for r in resolve.resolve_python(spark.createDataFrame(rows, "import_id long, path string, specifier string"), files, ["", "lib"]).collect()}
    assert got == {1: ("edge", "app/models/user.py"), 2: ("edge", "app/main.py"), 3: ("edge", "app/models/__init__.py"), 4: ("edge", "lib/tool.py"), 5: ("stdlib", "os"), 6: ("external", "requests"), 7: ("unresolved", None), 8: ("edge", "ns/deep/x.py"), 9: ("edge", "app/models/__init__.py")}


@pytest.mark.parametrize("step", [1, -1])
def test_a_long_cycle_settles_in_few_rounds(spark, monkeypatch, step):
    """A component of 100,000 vertices, against the order of ids and along it, and a tail that leads into it."""
    n, written = 100_000, []
    monkeypatch.setattr(G, "keep", lambda df: written.append(1) or keep(df))
    cycle = spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + step, F.lit(n)).alias("dst"))
    tail = spark.range(n, n + 5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.createDataFrame([(n + 5, 7)], "src long, dst long"))
    parts = G.scc(spark.range(n + 6), cycle.union(tail))
    assert sorted(tuple(r) for r in parts.groupBy("component").count().collect()) == [(0, n), *((n + i, 1) for i in range(6))]
    assert len(written) < 120  # twice two passes of about 18 rounds each: the tail's ids are larger, so its end is a root first


def test_strong_components_of_larger_graphs(spark):
    """Against reachability by brute force, on sparse graphs with many components and long chains."""
    for seed, n, m in ((1, 120, 150), (2, 80, 200), (3, 150, 150)):
        rng = random.Random(seed)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(0, n - 1, 2)] + [(i, i + 1) for i in range(40)]
        out = {i: {b for a, b in pairs if a == i} for i in range(n)}
        reach = {}
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                for j in out[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            reach[i] = seen
        want = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
        assert {r.id: r.component for r in G.scc(vertices_of(spark, n), edges_of(spark, pairs)).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranks_to_their_stop(spark, seed):
    """A hundred rounds on graphs with cycles, fewer where the ranks settle first."""
    rng = random.Random(seed)
    n = 12
    pairs = [(a, b) for a in range(n) for b in range(n) if rng.random() < 0.12 and (seed == 1 or a < b)]
    got = {r.id: r.page_rank for r in G.pagerank(vertices_of(spark, n), edges_of(spark, pairs), 100 if seed == 1 else 400, 1e-6).collect()}
    assert got == pytest.approx(brute_pagerank(n, pairs, 100 if seed == 1 else 400, 1e-6), abs=2e-6)
