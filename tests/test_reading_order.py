"""Roadmaps and entry points against plain Python over random inputs."""

from __future__ import annotations

import random
import re

import pytest

from quillstone.functions import constants as C
from quillstone.operators import cards
from quillstone.operators import graph as G


def roadmap_by_hand(files, entries, pairs):
    """files: id -> (path, classification, importance, in_degree); entries: id -> rank. Rows of the roadmap in order."""
    links = {(a, b) for a, b in pairs if a != b}
    out = {i: sorted(b for a, b in links if a == i) for i in files}

    def reached(i):
        seen, todo = {i}, [i]
        while todo:
            for j in out[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return seen

    reach = {i: reached(i) for i in files}
    members = {i: [j for j in files if j in reach[i] and i in reach[j]] for i in files}
    best = lambda ids: min(ids, key=lambda i: (-files[i][2], i))
    rep = {i: best(members[i]) for i in files}
    reps = set(rep.values())
    dag = {r: {rep[b] for a, b in links if rep[a] == r} - {r} for r in reps}
    rank = {}
    for i, k in entries.items():
        rank[rep[i]] = min(k, rank.get(rep[i], k))
    seeds = dict(sorted(rank.items(), key=lambda x: x[1])[: C.ROADMAP_SEEDS]) or {best(reps): 1}
    layer, front = dict.fromkeys(seeds, 0), set(seeds)
    while front:
        front = {b for a in front for b in dag[a]} - layer.keys()
        layer |= dict.fromkeys(front, max(layer.values()) + 1)

    def section(r):
        path, kind, _, _ = files[r]
        if layer.get(r) == 0:
            return "entry"
        if r in layer and not dag[r] and (kind in C.LEAF_CLASSES or set(path.lower().split("/")) & set(C.LEAF_SEGMENTS)):
            return "leaf-utility"
        return "unreached" if r not in layer else "core" if layer[r] <= 2 else "supporting"

    of = {r: section(r) for r in reps}
    by_weight = lambda ids: sorted(ids, key=lambda i: (-files[i][2], i))
    some = by_weight(r for r in reps if of[r] == "unreached")[: C.ROADMAP_UNREACHED]
    entry = [r for r in reps if of[r] == "entry"]
    room = min(max(C.ROADMAP_LENGTH, len(entry)), C.ROADMAP_MAX) - len(entry)
    kept = entry + by_weight([r for r in reps if of[r] not in ("entry", "unreached")] + some)[:room]
    place = {s: k for k, s in enumerate(("entry", "core", "supporting", "leaf-utility", "unreached"))}
    deep = lambda r: of[r] in ("core", "supporting")
    kept.sort(key=lambda r: (place[of[r]], seeds.get(r, 0), layer[r] if deep(r) else 0, -files[r][2], -files[r][3] if deep(r) else 0, r))
    return [(k, r, of[r], len(members[r]) - 1, out[r][: C.ROADMAP_DEPENDS], files[r][3], kept[k - 2] if k > 1 else None) for k, r in enumerate(kept, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_roadmaps(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 40, 90])
    pairs = [(a, b) for a in range(n) for b in rng.sample(range(n), min(n, rng.choice([0, 1, 2, 3]))) if a < b or rng.random() < 0.25]
    files = {i: (f"{rng.choice(['src', 'src/Utils', 'lib/core', 'app'])}/f{i}.py", rng.choice([*C.LEAF_CLASSES[:1], "source", "test"]), rng.randrange(8) / 8, sum(b == i for _, b in set(pairs))) for i in range(n)}
    entries = {i: k for k, i in enumerate(rng.sample(range(n), rng.choice([0, 1, 4])), 1)}
    f = spark.createDataFrame([(i, *v) for i, v in files.items()], "id long, path string, classification string, importance double, in_degree long")
    got = G.roadmap(f, spark.createDataFrame(list(entries.items()), "id long, rank int"), spark.createDataFrame(pairs, "src long, dst long"))
    assert [tuple(r) for r in got.orderBy("order").collect()] == roadmap_by_hand(files, entries, pairs)


def entry_points_by_hand(files, dirs, manifests, guards):
    """Rules in their order over the directories in theirs; the first that names a path counts."""
    found = {}
    join = lambda d, p: "/".join(x for x in (d, re.sub(r"^\./", "", p)) if x)
    for d in sorted(dirs):
        todo = []
        for at, main, bins, start in manifests:
            if at == d:
                script = re.search(r"([./\w-]+\.[cm]?[tj]sx?)\b", start or "")
                todo += [(0, main, "package.json#main", "main", 0)] if main is not None else []
                todo += [(1, to, "package.json#bin" + (f".{k}" if k else ""), "bin", 1) for k, to in sorted(bins.items())]
                todo += [(2, script.group(1), "package.json#scripts.start", "script", 4)] if script else []
        for _, base, evidence, kind, priority in sorted(todo, key=lambda x: (x[0], x[2])):
            path = next((join(d, base) + s for s in cards.MANIFEST_SUFFIXES if join(d, base) + s in files), None)
            if path:
                found.setdefault(path, (evidence, kind, priority))
        name = next((c for c in cards.CONVENTIONS if join(d, c) in files), None)
        if name:
            found.setdefault(join(d, name), (f"convention:{name}", "convention", 3))
    for path in files:
        if path.split("/")[-1] == "__main__.py":
            found.setdefault(path, ("python:__main__.py", "main", 2))
    for path in guards:
        found.setdefault(path, ("python:module-guard", "script", 5))
    ranked = sorted(found, key=lambda p: (found[p][2], p))
    return [(p, *found[p], k) for k, p in enumerate(ranked, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_entry_points(spark, seed):
    rng = random.Random(seed)
    dirs = ["", *rng.sample(["packages/a", "packages/b", "apps/web"], rng.randrange(3))]
    some = ["lib/x", "lib/x.js", "lib/x/index.js", "bin/run.js", "start.mjs", "s.py", "t/__main__.py", "__main__.py", *rng.sample(cards.CONVENTIONS, min(4, len(cards.CONVENTIONS)))]
    files = sorted({"/".join(x for x in (d, p) if x) for d in [*dirs, "elsewhere"] for p in rng.sample(some, rng.randrange(3, 9))})
    manifests = [(d, rng.choice([None, "./lib/x", "bin/run.js", "gone"]), dict(rng.sample([("", "./bin/run.js"), ("go", "lib/x.js"), ("x", "no.js")], rng.randrange(3))), rng.choice([None, "node start.mjs --x", "ts-node ./lib/x.js", "make"])) for d in [*dirs, "elsewhere"]]
    guards = rng.sample(files, 2)
    out = cards.entry_points(spark.createDataFrame([(p,) for p in files], "path string"), spark.createDataFrame([(d,) for d in dirs], "dir string"), spark.createDataFrame(manifests, "dir string, main string, bin map<string,string>, start string"), spark.createDataFrame([(p,) for p in guards], "path string"))
    assert [tuple(r) for r in out.select("path", "evidence", "kind", "priority", "rank").orderBy("rank").collect()] == entry_points_by_hand(files, dirs, manifests, guards)
