"""Vector codes, Merkle manifests and byte-pair encoding against SQL, brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, merkle, queries, vectorcodes
from quillstone.llm.oracles import ORACLES


def both(spark, tmp_path, name, table, data):
    pq.write_table(data, f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    ours, theirs = queries.queries()[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    return sorted(map(tuple, ours.collect()), key=repr), sorted(theirs.select(*ours.columns).fetchall(), key=repr)


def vectors(rows):
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("part", pa.string()), ("ref", pa.int32()), ("code", pa.int32())])
    return pa.Table.from_pylist([{"vec_id": i, "embedding": v, "label": k, "part": "x", "ref": 1, "code": None} for i, v, k in rows], kinds)


def test_vector_codes_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    make = lambda n: [(int(i), v.tolist(), int(i) % 5 if i % 7 else None) for i, v in zip(rng.permutation(n), rng.normal(0, 0.3, (n, 32)), strict=True)]
    rows = make(700) + [(9000 + i, [0.25] * 32, 1) for i in range(900)]  # one vector very often
    bad = [None, [], [None] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [float("-inf")] + [0.0] * 31]
    rows += [(20_000 + i, v, i) for i, v in enumerate(bad)] + [(5, [1.0] * 32, None), (5, [1.0] * 32, None), (5, [-1.0] * 32, 2), (None, [0.1] * 32, 3), (30_000, [300_000.0, -300_000.0] * 16, 4)]
    ours, theirs = both(spark, tmp_path, "op11_vector_codes", "embeddings", vectors(rows))
    assert ours == theirs and len(ours) == 1605


@pytest.mark.parametrize("n", [0, 1, 3, 64])
def test_few_vectors(spark, tmp_path, n):
    rows = [(i, [i / 7] * 16, None) for i in range(n)]
    ours, theirs = both(spark, tmp_path, "op11_vector_codes", "embeddings", vectors(rows))
    assert ours == theirs and len(ours) == n


def test_vector_lengths(spark):
    df = spark.createDataFrame([(1, [0.5] * 32, 1), (2, [0.5] * 16, 1), (3, [0.25] * 32, 2), (4, [1e30] * 32, 2)], "vec_id long, embedding array<float>, label int")
    out, books = vectorcodes.compress(df, entries=1)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in out.collect()}
    assert set(got) == {1, 3, 4} and got[4][1:] == (None, None) and got[3][2] is None and got[1][0] == "00" * 16 and books.shape == (16, 1, 2)
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [0.5] * 30, 1)], "vec_id long, embedding array<float>, label int"))


def test_short_lists_hold_the_nearest_entry():
    rng = np.random.default_rng(1)
    for width in (1, 3, 4):
        entries = rng.integers(-50, 50, (64, width))
        v = rng.integers(-60, 60, (40, 8, width)) // 3 + rng.integers(-40, 40, (40, 1, width))
        allowed = vectorcodes.short_lists(v.min(axis=1), v.max(axis=1), entries)
        assert 1 <= allowed.sum(axis=1).min() and allowed.mean() < 0.8
        index, distance = vectorcodes.nearest(v.reshape(-1, width), np.full(40, 8), allowed, entries)
        every = ((v.reshape(-1, 1, width) - entries) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


@pytest.mark.parametrize("width,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(width, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width), axis=-1).reshape(-1, width)
    place = vectorcodes.hilbert(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_blocks_hold_all_points_in_their_boxes(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rng.normal(0, 1, (500, 32)))], "vec_id long, embedding array<double>, label int")
    named = df.select(F.monotonically_increasing_id().alias("ref"), "vec_id", "label", vectorcodes.whole(F.col("embedding")).alias("q"))
    got = vectorcodes.blocks(vectorcodes.in_parts(named, np.array([[-300] * 32, [300] * 32]), 16), 2, 16).collect()
    assert sum(r.n for r in got) == 500 * 16
    for r in got:
        v = np.array(r.v).reshape(-1, 2)
        assert len(v) == r.n == len(r.ref) and v.min(axis=0).tolist() == r.low and v.max(axis=0).tolist() == r.high and v.sum(axis=0).tolist() == r.total


def manifest_by_hand(rows):
    """doc_id, source, lang, n_chars, text in lists: the rows of op12, by plain recursion."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda s: s if s is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in s)

    def tree(nodes):
        """The top, and for each node its siblings by level as (earlier, later)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for i, p in enumerate(at):
                run = level[p // 16 * 16 : p // 16 * 16 + 16]
                paths[i].append((run[: p % 16], run[p % 16 + 1 :]))
            level, at = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [p // 16 for p in at]
        return level[0], paths

    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([below[g][0] for g in names])
    for g, up in zip(names, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), below[g][1], strict=True):
            path = path + up
            fold = h("".join(map(field, (*r[:4], lower(r[4]))))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
            for a, b in path:
                fold = h("".join([*a, fold, *b]))
            out.append((r[0], leaf, below[g][0], root, h("".join(x for a, b in path for x in a + b)), fold, fold == root))
    return out


def document_rows(n, sources):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcXYZ é中:-") for _ in range(rng.randrange(12)))
    return [(i, rng.choice(sources), rng.choice(["en", None, "-"]), rng.choice([None, 7, -1]), rng.choice([None, "", word(), word()])) for i in range(n)]


@pytest.mark.parametrize("rows", [[], document_rows(1, ["a"]), document_rows(17, ["a"]), document_rows(300, ["a"]), document_rows(700, [None, "", "-", "é", "z", "Z", *map(str, range(20))]), document_rows(90, list(map(str, range(400)))), document_rows(40, ["a", "b"]) * 2 + [(None, "a", None, None, "A b"), (None, "a", None, None, "A b"), (None, "a", None, None, None)]])
def test_manifest(spark, tmp_path, rows):
    kinds = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string()), ("n", pa.int32()), ("at", pa.int32()), ("leaf", pa.string())])
    data = pa.Table.from_pylist([dict(zip(kinds.names, (*r, 3, 4, "x"), strict=True)) for r in rows], kinds)
    ours, theirs = both(spark, tmp_path, "op12_merkle_manifest", "documents", data)
    assert ours == theirs == sorted(manifest_by_hand(rows) if rows else [], key=repr)


def test_other_fanouts_and_a_very_long_text(spark):
    df = spark.createDataFrame([(i, "s", "x" * (3_000_000 if i == 5 else i)) for i in range(23)], "doc_id long, source string, text string")
    out = merkle.manifest(df, ["doc_id", "text"], fanout=3).withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(out) == 23 and all(r.again == r.root == r.subroot and r.claimed == r.leaf and len(r.path) == 3 for r in out)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(seed, n):
    rng = random.Random(seed)
    pool = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 .,;:!?'\"\n\t -_#é ßİıΣσςÅǺ̈ﬁＡ中文字한국어日本カナ🎉👍🏽 \u0085​\x1c\x00<|>ǅ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(n)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(50))) for _ in range(n)]
    texts += [rng.choice(["<|endoftext|>", "<|startoftext|>", "<|End"]) + rng.choice(texts) + "<|endoftext|>" + rng.choice(["", " x", "<|startoftext|>"]) for _ in range(n)]
    return [None, "", " ", "\n\n", "don't we'll I'm", "a" * 40_000, "ab " * 60_000, *texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_is_the_librarys(spark, name):
    texts = odd_texts(7, 700)
    vocabulary = bpe.share_vocabulary(spark, queries.tokenizer_path(name))
    df = spark.createDataFrame([(None if i == 4 else i // 2, t, "x", 1, i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int, at long").repartition(3)
    got = {r.at: r for r in bpe.decode(bpe.encode(df, vocabulary, id_col="at"), vocabulary).collect()}
    own = library(name)
    for i, text in enumerate(texts):
        want = own.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want, text
        assert got[i].decoded == own.decode(want, skip_special_tokens=False), text


def test_ids_that_are_no_tokens(spark):
    vocabulary = bpe.share_vocabulary(spark, queries.tokenizer_path("word_bpe_49k.json"))
    df = spark.createDataFrame([(1, [320, 60_000, -1, 320]), (2, None), (3, [])], "k int, ids array<int>")
    own = library("word_bpe_49k.json")
    assert [r.decoded for r in bpe.decode(df, vocabulary).orderBy("k").collect()] == [own.decode([320, 60_000, 320], skip_special_tokens=False), "", ""]


def test_bpe_query(spark, tmp_path):
    texts = odd_texts(9, 60)
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "ids": pa.array([1] * len(texts))}), f"{tmp_path}/documents.parquet")
    own, sha = library("word_bpe_49k.json"), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.queries()["op13_bpe"](spark, str(tmp_path)).collect())) == want


def test_one_last_token_for_every_prefix():
    """Of the tokens that end at a place exactly one fits, so the order in which they are tried doesn't matter."""
    model = bpe.PrefixModel(bpe.read_vocabulary(queries.tokenizer_path("word_bpe_49k.json")))
    rng = random.Random(2)
    spelled = {s: t for t, s in enumerate(model_strings(model))}
    for _ in range(300):
        word = "".join(rng.choice("abeinorsthgl") for _ in range(rng.randrange(1, 14)))
        symbols = [model.symbols[c] for c in word]
        last = [-1]
        for place in range(1, len(word) + 1):
            ends = [t for n in range(1, place + 1) if (t := spelled.get(tuple(symbols[place - n : place]))) is not None and (n == place or model.fits(last[place - n], t))]
            assert len(ends) == 1
            last += ends


def model_strings(model):
    spelled = [(t,) for t in range(model.n)]
    for t in range(model.n, len(model.left)):
        spelled.append(spelled[model.left[t]] + spelled[model.right[t]])
    return spelled
