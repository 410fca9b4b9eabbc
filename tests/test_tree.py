"""Trees with links against a walk by hand."""

from __future__ import annotations

import hashlib
import os
import random
import re

import pytest

from quillstone.functions import constants as C
from quillstone.functions.paths import ignore_regex
from quillstone.sources import files as S
from quillstone.sources.tree import TreeReader, read_tree, scan_tree


def walked(root, exclude=()):
    """Files with sizes and skipped directories of a walk that is depth first, by name and enters each real directory once."""
    files, loops, seen = {}, [], {os.path.realpath(root)}
    patterns = [re.compile(ignore_regex(g)) for g in (*C.IGNORED_GLOBS, *exclude)]

    def visit(folder, rel):
        for name in sorted(os.listdir(folder), key=str.encode):
            at, path = os.path.join(folder, name), f"{rel}/{name}".lstrip("/")
            if not os.path.exists(at) or set(path.split("/")) & set(C.IGNORED_DIRS) or any(p.search(path) for p in patterns):
                continue
            if not os.path.isdir(at):
                if os.path.isfile(at):
                    files[path] = os.path.getsize(at)
            elif (real := os.path.realpath(at)) in seen:
                loops.append(path)
            else:
                seen.add(real)
                visit(at, path)

    visit(root, "")
    return files, sorted(loops)


def scanned(spark, root, **more):
    files, diagnostics = scan_tree(spark, str(root), **more)
    rows, told = files.collect(), diagnostics.collect()
    assert len({r.path for r in rows}) == len(rows) and {r.code for r in told} <= {"SYMLINK_LOOP_SKIPPED"}
    return {r.path: r.size_bytes for r in rows}, sorted(r.path for r in told)


def test_loops_broken_links_and_targets_elsewhere(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    for d in ("a/b/c", "z/deep", "node_modules/pkg/lib", ".git", "docs"):
        (root / d).mkdir(parents=True)
    (other / "inner").mkdir(parents=True)
    for i, f in enumerate(("top.py", "a/one.py", "a/b/two.py", "a/b/c/three.py", "z/four.py", "z/deep/five.py", "node_modules/pkg/lib/six.js", ".git/seven", "docs/eight.md", "a/x.min.js")):
        (root / f).write_text("x" * i)
    (other / "nine.py").write_text("nine")
    (other / "inner/ten.py").write_text("ten")
    links = {"a/b/up": root, "a/b/side": root / "z", "a/self": root / "a", "zz": root / "z", "broken": root / "nowhere", "a/file.py": root / "top.py", "out": other, "a/out2": other / "inner", "pkg": root / "node_modules/pkg", "m/back": root / "a/b"}
    (root / "m").mkdir()
    (other / "home").symlink_to(root / "docs")
    (other / "inner/loop").symlink_to(other)
    for name, to in links.items():
        (root / name).symlink_to(to)
    os.mkfifo(root / "pipe")
    for partitions in (1, 3, 64):
        assert scanned(spark, root, partitions=partitions) == walked(root)
    files, loops = walked(root)
    assert "a/b/side/four.py" in files and "zz" in loops and "z" in loops and "pkg/lib/six.js" in files and "a/out2/ten.py" in files and "broken" not in files
    assert scanned(spark, root, exclude=["a/b/**", "*.md"]) == walked(root, ["a/b/**", "*.md"])


@pytest.mark.parametrize("seed", range(4))
def test_random_trees(spark, tmp_path, seed):
    rng = random.Random(seed)
    folders = [tmp_path / "root"]
    folders[0].mkdir()
    for _ in range(25):
        d = rng.choice(folders) / rng.choice("abcdefghij")
        if not d.exists():
            d.mkdir()
            folders.append(d)
    for _ in range(30):
        (rng.choice(folders) / f"f{rng.randrange(9)}.txt").write_text("x" * rng.randrange(50))
    for _ in range(14):
        link = rng.choice(folders) / rng.choice(["A", "aa", "b1", "cc", "kk", "zz"])
        if not link.exists() and not link.is_symlink():
            link.symlink_to(rng.choice([*folders, tmp_path / "gone"]))
    assert scanned(spark, folders[0], partitions=rng.choice([1, 4, 16])) == walked(folders[0])


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/good.py").write_bytes(b"a = 1\n\xff\n")
    (tmp_path / "d/bad.py").symlink_to("/proc/self/mem")  # can be opened but not read, even by root
    files, diagnostics = read_tree(scan_tree(spark, str(tmp_path))[0])
    assert [tuple(r) for r in diagnostics.collect()] == [("FILE_UNREADABLE", "d/bad.py")]
    rows = {r.path: r for r in S.read_text(files).collect()}
    bad, good = rows["d/bad.py"], rows["d/good.py"]
    assert (bad.text, bad.skip_reason, bad.content_hash, bad.line_count) == ("", "unreadable", hashlib.sha256(b"").hexdigest(), 0)
    assert good.skip_reason is None and good.is_lossy and good.content_hash == hashlib.sha256(b"a = 1\n\xff\n").hexdigest()


def test_partitions_are_directories(tmp_path):
    for i in range(5):
        for j in range(4):
            (tmp_path / f"{i}/{j}").mkdir(parents=True)
            (tmp_path / f"{i}/{j}/f").write_text("")
    reader = TreeReader({"path": str(tmp_path), "partitions": "8"})
    parts = reader.partitions()
    assert sum(len(p.deep) for p in parts) == 20 and sum(len(p.flat) for p in parts) == 6 and len(parts) == 8
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len({(r["dir"], r["name"]) for r in rows}) == 5 + 20 + 20
