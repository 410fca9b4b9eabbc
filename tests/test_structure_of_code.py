"""Parsing, manifests, entry points, cards, walks and run splitting against hand-made and brute-force results."""

from __future__ import annotations

import hashlib
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import cards, graph, parse, search, structure
from quillstone.sources import files as S
from quillstone.sources import tables
from quillstone.sources.index import PostingIndex
from quillstone.streaming import limits

SCRIPT = '''// import gone from './commented';
import {
  a,
  b,
} from './x';
import type { T } from '../t'; import './side';
export { c } from "./re";
/* require('no') */
const q = require('lib'), r2 = "import('s')";
const re = /["'`{]/g;
export default class Foo extends Bar {
  private static async run<T>(x: T): Promise<void> {
    if (x) { return import('./lazy'); }
  }
  get value() { return `a ${b} import('z')`; }
  abstract nope(): void;
}
export const useName = (a: string) => {
  function inner() { return 1; }
  return a;
};
type U = { a: string } | null;
export enum E { A, B }
router.get('/users/:id', auth, handler);
async function* gen() {}
const x = function named() {};
export function over(a: number): string;
export const multi =
  cond ? 1 :
  2;
'''


def test_scripts_are_read_as_whole_texts(spark):
    files = spark.createDataFrame([("a.ts", SCRIPT), ("b.ts", "/* open\nimport x from 'y'"), ("c.js", "f({"), ("d.ts", None)], "path string, text string")
    got = [(r.specifier, r.line, r.kind, r.is_type_only) for r in parse.script_imports(files).collect()]
    assert got == [("./x", 2, "static", False), ("../t", 6, "type", True), ("./side", 6, "static", False), ("./re", 7, "reexport", False), ("lib", 9, "require", False), ("./lazy", 13, "dynamic", False)]
    symbols = {(r.name, r.kind, r.start_line, r.end_line, r.is_exported, r.container_name) for r in parse.script_symbols(files.where("path = 'a.ts'")).collect()}
    assert symbols == {
        ("q", "const", 9, 9, False, None), ("re", "const", 10, 10, False, None), ("Foo", "class", 11, 17, True, None), ("run", "method", 12, 14, False, "Foo"), ("value", "method", 15, 15, False, "Foo"),
        ("useName", "hook", 18, 21, True, None), ("inner", "function", 19, 19, False, None), ("U", "type", 22, 22, False, None), ("E", "enum", 23, 23, True, None), ("/users/:id", "route", 24, 24, False, None),
        ("gen", "function", 25, 25, False, None), ("x", "const", 26, 26, False, None), ("multi", "const", 28, 30, True, None),
    }
    assert {(r.path, r.severity) for r in parse.parse_failures(files).collect()} == {("b.ts", "warning"), ("c.js", "warning")}


def test_python_keeps_what_it_can_read(spark):
    py = "import a\ndef broken(:\n@app.get('/x')\n@app.post('/x')\ndef f():\n    class In:\n        def m(self):\n            def deep(): pass\n@mock.patch('os.environ')\ndef g(): pass\nX = Y = 1\nz: int = 2\nimportlib.import_module(name)\n"
    files = spark.createDataFrame([("a.py", py)], "path string, text string")
    got = {(r.name, r.kind, r.start_line, r.container_name) for r in parse.python_symbols(files).collect()}
    assert got == {("f", "function", 3, None), ("/x", "route", 3, None), ("/x", "route", 4, None), ("In", "class", 6, "f"), ("m", "method", 7, "In"), ("deep", "function", 8, "m"), ("g", "function", 9, None), ("X", "const", 11, None), ("z", "variable", 12, None)}
    assert [(r.specifier, r.is_literal) for r in parse.python_imports(files).collect()] == [("a", True), ("name", False)]
    failures = parse.parse_failures(files)
    assert [(r.severity, r.code) for r in failures.collect()] == [("warning", "PARSE_FAILED")]
    parse.require_some_parsed(files, failures)
    with pytest.raises(RuntimeError):
        parse.require_some_parsed(files, failures.withColumn("severity", F.lit("error")))


def test_manifests_of_all_kinds(spark):
    texts = {
        "package.json": '{"name": "n", "version": "1", "dependencies": {"react": "^18"}, "peerDependencies": {"vue": "*"}, "workspaces": ["packages/*", "apps/*"]}',
        "bad/package.json": '{"name": ',
        "composer.json": '{"name": "c", "require": {"php": ">=8"}, "require-dev": {"phpunit": "9"}}',
        "a/requirements.txt": "-r x\n# c\nFlask[a]==2 ; py\nq\n",
        "b/pyproject.toml": '[project]\nname = "p"\nversion = "3"\ndependencies = [\n  "httpx>=0.2",\n  \'rich\',\n]\n[tool.poetry.dependencies]\npython = "^3"\nAttrs = { version = "^1", optional = true }\n[tool.poetry.group.dev.dependencies]\nmypy = "1.0"\n[tool.other]\nx = "1"\n',
        "c/setup.py": "setup(\n    name='s',\n    version='4',\n    install_requires=['six>=1', \"toml\"],\n)\n",
        "d/Pipfile": '[packages]\nfoo = "*"\n[dev-packages]\nbar = ">=1"\n',
        "e/go.mod": "module m.io/x\n\ngo 1.20\nrequire one.io/a v1.0.0\nrequire (\n\ttwo.io/b v2.0.0 // indirect\n)\nreplace three.io/c => four.io/d v9.0.0\n",
        "f/Cargo.toml": '[package]\nname = "cr"\nversion = "0.1"\n[dependencies]\nserde = { version = "1" }\n[dev-dependencies]\ntmp = "2"\n[profile.release]\nlto = "x"\n',
        "g/pom.xml": "<project><parent><artifactId>par</artifactId></parent><artifactId>mv</artifactId><version>5</version><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>j</groupId><artifactId>u</artifactId><scope>test</scope></dependency></dependencies></project>",
        "pnpm-workspace.yaml": "packages:\n  - 'libs/*'\n  # c\n  - tools\nother:\n  - no\n",
        "lerna.json": '{"packages": ["l/*"]}',
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert {r.path: (r.ecosystem, r.project_name, r.version) for r in S.manifests(files).collect()} == {
        "package.json": ("npm", "n", "1"), "bad/package.json": ("npm", None, None), "composer.json": ("composer", "c", None), "a/requirements.txt": ("pypi", None, None), "b/pyproject.toml": ("pypi", "p", "3"),
        "c/setup.py": ("pypi", "s", "4"), "d/Pipfile": ("pypi", None, None), "e/go.mod": ("go", "m.io/x", None), "f/Cargo.toml": ("cargo", "cr", "0.1"), "g/pom.xml": ("maven", "mv", "5"),
    }
    assert {(r.ecosystem, r.name, r.version_spec, r.scope) for r in S.dependencies(files).collect()} == {
        ("npm", "react", "^18", "runtime"), ("npm", "vue", "*", "peer"), ("composer", "php", ">=8", "runtime"), ("composer", "phpunit", "9", "dev"), ("pypi", "flask", "==2", "runtime"), ("pypi", "q", "", "runtime"),
        ("pypi", "httpx", ">=0.2", "runtime"), ("pypi", "rich", "", "runtime"), ("pypi", "attrs", "^1", "runtime"), ("pypi", "mypy", "1.0", "dev"), ("pypi", "six", ">=1", "runtime"), ("pypi", "toml", "", "runtime"),
        ("pypi", "foo", "*", "runtime"), ("pypi", "bar", ">=1", "dev"), ("go", "one.io/a", "v1.0.0", "runtime"), ("go", "two.io/b", "v2.0.0", "indirect"), ("cargo", "serde", "1", "runtime"), ("cargo", "tmp", "2", "dev"),
        ("maven", "g:a", "1", "runtime"), ("maven", "j:u", "", "dev"),
    }
    assert [r.path for r in S.manifest_failures(files).collect()] == ["bad/package.json"]
    assert {(r.source, r.glob) for r in S.workspace_globs(files).collect()} == {("package.json", "packages/*"), ("package.json", "apps/*"), ("pnpm-workspace.yaml", "libs/*"), ("pnpm-workspace.yaml", "tools"), ("lerna.json", "l/*")}


def test_settings_ids_and_ignores(spark):
    assert S.read_settings('{"keywords": {"a": ["b", 1], "c": "d"}}') == {"a": ["b"]} and S.read_settings("[") == S.read_settings(None) == S.read_settings("[1]") == {}
    assert search.merged_keywords({"auth": ["x"]}, {"auth": ["y"], "z": ["w"]}) == {"auth": ["x"], "z": ["w"]}
    ids = spark.createDataFrame([("/a/b/",), ("/a/b",), ("/a/c",)], "p string").select(S.repo_id(F.col("p")).alias("i")).collect()
    assert ids[0] == ids[1] != ids[2] and len(ids[0].i) == 16
    ignore = spark.createDataFrame([(".gitignore", "# c\n*.log\n/build\n!keep.log\nsub/**/x.txt\n")], "path string, text string")
    files = spark.createDataFrame([("a.log",), ("d/keep.log",), ("build/o",), ("d/build/o",), ("sub/x.txt",), ("sub/q/r/x.txt",), ("alog",)], "path string")
    assert {r.path for r in S.nested_ignores(files, S.read_gitignore(ignore)).collect()} == {"d/keep.log", "d/build/o", "alog"}


def test_kinds_roots_and_entry_points(spark):
    m = spark.createDataFrame([("a", "package.json"), ("b", "setup.py"), ("c", "package.json"), ("d", "go.mod")], "repo string, kind string")
    d = spark.createDataFrame([("a", "react"), ("a", "next"), ("b", "django")], "repo string, name string")
    w = spark.createDataFrame([("c", "x"), ("c", "y")], "repo string, dir string")
    assert {r.repo: r.label for r in cards.detected_type(m, d, w).collect()} == {"a": "Next.js application", "b": "Python web application", "c": "Monorepo (2 workspaces)", "d": "Unknown project type"}
    assert cards.source_roots(w) == ["x", "y"] and cards.source_roots(w.limit(0)) == [""]
    files = spark.createDataFrame([(p,) for p in ("src/index.ts", "lib/main.js", "pk/index.js", "pk/cli.ts", "t/__main__.py", "s.py", "srv.ts")], "path string")
    dirs = spark.createDataFrame([("",), ("pk",)], "dir string")
    manifests = spark.createDataFrame([("", "./lib/main", {"": "lib/main.js"}, "node ./srv.ts --x"), ("pk", None, {"run": "cli", "no": "gone"}, None)], "dir string, main string, bin map<string,string>, start string")
    out = cards.entry_points(files, dirs, manifests, spark.createDataFrame([("s.py",), ("t/__main__.py",)], "path string")).orderBy("rank").collect()
    assert [(r.path, r.evidence, r.kind) for r in out] == [("lib/main.js", "package.json#main", "main"), ("pk/cli.ts", "package.json#bin.run", "bin"), ("t/__main__.py", "python:__main__.py", "main"), ("pk/index.js", "convention:index.js", "convention"), ("src/index.ts", "convention:src/index.ts", "convention"), ("srv.ts", "package.json#scripts.start", "script"), ("s.py", "python:module-guard", "script")]


def test_reasons_of_steps(spark):
    steps = spark.createDataFrame([(1, 1, "entry", 0), (2, 2, "core", 0), (3, 3, "core", 2), (4, 4, "core", 0), (5, 5, "leaf-utility", 0), (6, 6, "unreached", 0), (7, 7, "supporting", 0)], "order long, id long, section string, n_companions long").withColumn("evidence", F.lit("main"))
    files = spark.createDataFrame([(i, f"d/f{i}.ts", "util", r, i, "m" if i % 2 else None) for i, r in ((1, 9), (2, 1), (3, 8), (4, 7), (5, 6), (6, 5), (7, 4))], "id long, path string, classification string, importance_rank long, in_degree long, module string")
    why = [r.why for r in cards.reasons(steps, files).orderBy("order").collect()]
    assert why == ["Entry point (main). Start reading here.", "Imported by 2 files (rank #1 by centrality) — the hub of this repository.", "Part of a 3-file import cycle; read these together.", "util used by 4 files; reached directly from f3.ts.", "Leaf utility imported by 5 files; read last, for reference.", "Not reached from any entry point — likely dead code or a separate tool.", "util in m; imported by 7 files."]


def brute_walk(members, out):
    path, seen, at = [], set(), min(members)
    while True:
        seen.add(at)
        path.append(at)
        left = [m for m in members if m not in seen]
        if not left:
            return path
        nexts = [n for n in out.get(at, ()) if n in members and n not in seen]
        at = min(nexts) if nexts else min(left)


def test_components_and_walks_match_brute_force(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(i, i + 1) for i in range(50, 80)} | {(80, 50)}  # and one long cycle
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    reach = {v: {v} for v in range(90)}
    for v in reach:
        todo = [v]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in reach[v]:
                    reach[v].add(n)
                    todo.append(n)
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    parts = graph.scc(spark.range(90), e).cache()
    assert {r.id: r.component for r in parts.collect()} == want
    assert graph.component_count(parts).first()[0] == len(set(want.values()))
    groups = {c: [v for v in want if want[v] == c] for c in set(want.values())}
    walks = {r.component: r.path for r in graph.cycle_paths(parts, e).collect()}
    assert walks == {c: brute_walk(g, out) for c, g in groups.items() if len(g) > 1}
    assert {r.path for r in graph.cycle_paths(parts, e, largest=1).collect()} == {None}
    layers = {r.id: r.layer for r in graph.bfs_layers(spark.createDataFrame([(50,)], "id long"), e, 40).collect()}
    assert layers == {50 + i: i for i in range(31)}


def test_runs_of_events_split_at_pauses(spark):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([1, 2, 5, 40, 400])
        rows.append(("hot" if i % 3 else f"k{i % 5}", i, t))
    df = spark.createDataFrame(rows, "k string, id long, t long").select("k", "id", F.timestamp_seconds("t").alias("ts"), (F.col("id") % 50 == 7).alias("done"))
    want, passed, taken = {}, {}, {}
    for k, i, t in rows:
        q = taken.setdefault(k, deque())
        while q and q[0] <= t - 60:
            q.popleft()
        want[i] = (len(q) < 3, None if len(q) < 3 else q[0] + 60 - t + 1)
        if len(q) < 3:
            q.append(t)
    assert {r.id: (r.admitted, r.retry_after_s) for r in limits.admit(df, "k", "ts", "id", 3, 60).collect()} == want
    spaced = {}
    for k, i, t in rows:
        spaced[i] = k not in passed or t - passed[k] >= 30 or i % 50 == 7
        if spaced[i]:
            passed[k] = t
    assert {r.id: r.admitted for r in limits.throttle(df, "k", "ts", "id", 30, "done").collect()} == spaced
    runs = limits.with_runs(df.select("k", "id", F.unix_micros("ts").alias("us")).repartition(7), "k", "us", "id", 60_000_000)
    begun, last = {}, {}
    for k, i, t in rows:
        begun[k] = t if k not in last or t - last[k] >= 60 else begun[k]
        last[k] = t
        assert begun[k] >= 0
    assert {r.k: r.run for r in runs.groupBy("k").agg(F.max("run").alias("run")).collect()} == {k: v * 1_000_000 for k, v in begun.items()}


def test_postings_and_their_index(spark, tmp_path):
    rows = [("a", "getHTTPName get_x get\n\nget GET xy"), ("b", None), ("c", ""), ("d", "\n".join(["tok"] * 30))]
    files = spark.createDataFrame(rows, "path string, text string")
    each = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).select("path", "at", F.explode(T.tokens(F.col("line"))).alias("token"))
    want = {(r.token, r.path): (r.n, sorted(set(r.at))[:20]) for r in each.groupBy("token", "path").agg(F.count("*").alias("n"), F.collect_list(F.col("at") + 1).alias("at")).collect()}
    index = search.postings(files)
    assert {(r.token, r.path): (r["count"], r.lines) for r in index.collect()} == want
    assert {(r.token, r.path) for r in search.postings(files, ["get", "nope"]).collect()} == {("get", "a")}
    stored = PostingIndex(spark, str(tmp_path / "index"))
    stored.create(index)
    found = stored.read(["get", "tok"])
    assert {(r.token, r.path) for r in found.collect()} == {("get", "a"), ("tok", "d")}
    assert "bucket" in found._jdf.queryExecution().toString() and "PushedFilters: [In(token" in found._jdf.queryExecution().toString()


def test_canonical_json_and_fingerprint(spark):
    df = spark.createDataFrame([(2, None, {"b": 1.5, "a": None}, (1, ["x", None])), (1, "é", None, None)], "z int, a string, m map<string,double>, s struct<q:int,p:array<string>>")
    got = [r[0] for r in df.orderBy("z").select(structure.canonical_json(df)).collect()]
    assert got == ['{"a":"é","m":null,"s":null,"z":1}', '{"a":null,"m":{"a":null,"b":1.5},"s":{"p":["x",null],"q":1},"z":2}']
    assert structure.fingerprint(df).collect() == structure.fingerprint(df.orderBy("z").repartition(3)).collect() != structure.fingerprint(df.limit(1)).collect()
    with pytest.raises(Exception, match="no JSON number"):
        spark.createDataFrame([(float("nan"),)], "x double").select(structure.canonical_json(spark.createDataFrame([(1.0,)], "x double"))).collect()


def test_fingerprints_of_documents(spark):
    df = spark.createDataFrame([(1, "é", "x")], "b int, a string, fingerprint string")
    want = hashlib.sha256('{"a":"é","b":1,"fingerprint":""}'.encode()).hexdigest()
    assert structure.document_fingerprint(df).first().fingerprint == want == structure.document_fingerprint(df.drop("fingerprint")).first().fingerprint


def test_kept_tables_go_with_their_block(spark, tmp_path):
    with tables.scratch(spark) as folder:
        kept = tables.keep(spark.range(10))
        tables.keep(kept.where("id > 3")).write.parquet(str(tmp_path / "out"))
        assert len(os.listdir(folder.removeprefix("file:"))) == 2
    assert not os.path.exists(folder.removeprefix("file:")) and spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert tables.keep(spark.range(3)).count() == 3


def test_fallback_of_questions(spark):
    important = spark.createDataFrame([("a", 1), ("b", 2)], "path string, place long")
    hits = spark.createDataFrame([("z", 1)], "path string, place long")
    assert [r.path for r in cards.ask_fallback(hits, important).collect()] == ["z"]
    assert {r.path for r in cards.ask_fallback(hits.limit(0), important).collect()} == {"a", "b"}
