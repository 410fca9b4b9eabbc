"""Each operator against brute force, over small tables with nulls, empties, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import chat, decontam, kernels, licenses, linedup, neardup, packing, quality, secrets, shared, tokens, urlfilter
from quillstone.llm.queries import tokenizer_path

WORDS = ["alpha", "beta", "Gamma", "delta", "ünï", "ep-silon", "zeta,", "eta.", "the", "of", "漢字", "x1"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", str(rng.randrange(30))]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in t.split()) for t in base[:15]]
    lines = ["\n".join([base[i], base[i + 1], "", base[i]]) for i in range(5)]
    odd = [None, "", " \t\n ", "one", "two words", "\n\n\n", "a b c  d", "x" * 3000, prose(rng, 6000), "tab\tand\x0bvt and\x0cff\r\n"]
    return base + near + base[:6] + lines + odd


def documents(spark, values=None, clash=False):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts() if values is None else values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    if clash:
        for name in ("node", "label", "n_words", "score", "fp", "row", "removed", "id", "start", "key", "__removed", "__id", "__fp", "cutoff", "component"):
            df = df.withColumn(name, F.lit("x"))
    return df


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_kernels_agree_with_regular_expressions():
    values = texts(3)
    got = []
    for _, _, raw, offsets in kernels.blocks(pa.array(values), 500):
        starts, ends, first = kernels.spans(raw, offsets, kernels.SPACE)
        h = kernels.span_hashes(raw, starts, ends)
        words = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
        got += [list(zip(words[a:b], h[a:b].tolist())) for a, b in zip(first[:-1], first[1:])]
    assert [[w for w, _ in x] for x in got] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in values]
    by_word = defaultdict(set)
    for x in got:
        for w, h in x:
            by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)


# --- chat -------------------------------------------------------------------------------------------------------------
def test_chat_keeps_maximal_conversations(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, ("user", "")], 5: [a, b, c], 6: [b], 7: [b, a], None: [("system", "s")]}
    rows = [(k, t, r, x, "z") for k, v in convs.items() for t, (r, x) in enumerate(v)]
    rows += rows[:3]  # repeated rows are one turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string")
    out = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(df).collect()}
    assert set(out) == {3, 4, 7, None}
    assert out[3] == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\n<|end|>\n")
    assert chat.render(df.limit(0)).count() == 0


# --- quality ----------------------------------------------------------------------------------------------------------
def test_quality_counts_match_brute_force(spark):
    rows = {r.doc_id: r for r in quality.features(documents(spark, clash=True)).collect()}
    for i, t in enumerate(texts()):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.n_upper) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= x <= "Z" for x in t)), i


def test_cutoffs_bound_false_rejection(spark):
    rng = random.Random(5)
    rows = [(i, "a" if i % 2 else "b", rng.choice([0, 10, 30, 60]) if i % 4 else 900) for i in range(8000)]
    labels = [(i, 1 if i % 4 else 0) for i in range(8000)] + [(99999, 1), (5, None)]
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, score long")
    got = {r.stratum: r for r in quality.cutoffs(scored, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert set(got) == {"b"} and got["b"].n_rejected == 0 and 60 <= got["b"].cutoff < 900  # bad documents lie in b alone
    few = quality.cutoffs(scored.limit(300), spark.createDataFrame(labels[:300], "doc_id long, quality int"))
    assert few.count() == 0  # too few labels to be sure of anything


def test_binomial_bound_is_exact(spark):
    from math import comb

    got = spark.createDataFrame([(k, n) for n in (1, 50, 700) for k in (0, 1, 3, 6) if k <= n], "k long, n long").withColumn("p", quality.binomial_cdf("k", "n", 0.01)).collect()
    for r in got:
        want = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == (1.0 if r.k > r.n * 0.01 else pytest.approx(want, rel=1e-9))


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality(documents(spark), none).collect()
    assert all(r.kept == (not r.base_failed) for r in out) and len(out) == len(texts())
    assert quality.quality(documents(spark).limit(0), none).count() == 0


# --- lines ------------------------------------------------------------------------------------------------------------
def test_patience_is_the_longest_rising_series():
    assert linedup.patience([]) == [] and linedup.patience([(1, 7)]) == [0]
    assert linedup.patience([(0, 3), (1, 0), (2, 1), (3, 2)]) == [1, 2, 3]
    rng = random.Random(2)
    for _ in range(200):
        there = rng.sample(range(30), rng.randrange(1, 9))
        got = linedup.patience(list(enumerate(there)))
        best = max(k for k in range(1, len(there) + 1) for c in combinations(there, k) if list(c) == sorted(c))
        assert len(got) == best and all(a < b and there[a] < there[b] for a, b in zip(got, got[1:]))


def test_align_names_blocks_and_their_places():
    run = lambda at, there: (at, at + 1, there)
    assert linedup.align([run(0, 4), run(1, 5), run(3, 8)], bytearray(4)) == [(0, 2, 4), (3, 4, 8)]
    gone = bytearray(6)  # exchanged passages are matched one after the other, a recurring line wherever it is
    blocks = linedup.align([run(0, 5), run(1, 6), run(2, 0), run(3, 1), run(4, 2), run(5, 2)], gone)
    assert all(gone) and (0, 2, 5) in blocks and (2, 4, 0) in blocks
    assert linedup.align([run(i, 7) for i in range(50_000)], gone := bytearray(50_000)) and all(gone)


def test_line_dedup_deletes_from_later_documents(spark):
    p = ["passage %d one two three four five six seven eight" % i for i in range(4)]
    own = lambda i: f"own line number {i} with many other words in it"
    values = ["\n".join([own(0), *p, own(1)]), "\n".join([own(2), *p[:2], own(3)]), "\n".join([own(4), p[1], p[0]]), own(5), "\n".join([own(0), *p, own(1)]), None, ""]
    docs = documents(spark, values, clash=True)
    found = linedup.line_overlaps(docs)
    removed = {r.doc_id: r.removed for r in found.collect()}
    assert removed[0] == [] and removed[1] == [1, 2] and removed[4] == [0, 1, 2, 3, 4, 5] and removed[3] == removed[5] == removed[6] == []
    assert removed[2] == [1, 2]  # exchanged
    blocks = {r.doc_id: [(b.at, b.to, b.partner, b.partner_at) for b in r.blocks] for r in found.collect()}
    assert blocks[1] == [(1, 3, 0, 1)] and blocks[4] == [(0, 6, 0, 0)] and blocks[0] == []
    out = linedup.remove_lines(docs, found)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[0] == values[0] and left[1] == f"{own(2)}\n{own(3)}" and left[4] == "" and left[5] is None and left[6] == ""
    twice = linedup.remove_lines(docs.union(docs), linedup.line_overlaps(docs.union(docs)))
    assert twice.count() == 2 * len(values) and {r.doc_id: r.text for r in twice.collect()} == left
    assert linedup.line_overlaps(docs.limit(0)).count() == 0


# --- secrets ----------------------------------------------------------------------------------------------------------
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def test_secret_spans(spark):
    rng = random.Random(9)
    bits = ["token: ", "TOKEN='", "api_key=", "apikey:", "secret", "password", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef", "é", "😀", " ", "\n", "abc", "abcdef", "Q8xZ2Lm9", "pT4vB7nK", '"', "="]
    values = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [None, "", "q8Jd0sKf93LmZx72PqRt55VbNw", "exampleq8Jd0sKf93LmZx72PqRt55VbNw", "aaaaaaaaaaaaaaaaaaaaaaaa1A"]
    out = secrets.secret_spans(documents(spark, values)).select("doc_id", secrets.joined("base").alias("b"), secrets.joined("added").alias("a")).collect()
    for r in out:
        t = values[r.doc_id] or ""
        found = sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in re.finditer(p, t) if ok(m))
        assert r.b == ",".join(f"{k}:{a}:{b}" for a, _, k, b in found), t
    added = {r.doc_id: r.a for r in out}
    assert added[302] == "entropy:0:26" and added[303] == added[304] == ""
    assert secrets.secret_spans(documents(spark).limit(0)).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------
def brute_components(values, k, percent):
    sets = []
    for t in values:
        w = ascii_lower(t or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    out = neardup.near_duplicates(documents(spark, clash=True), shingle_words=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(texts(), k, 80)


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(11)
    w = prose(rng, 200).split()
    values = []
    for _ in range(150):  # neighbours of one text, many of which are not alike among themselves
        v = list(w)
        for _ in range(rng.randrange(0, 12)):
            v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
        values.append(" ".join(v))
    out = neardup.near_duplicates(documents(spark, values), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(values, 4, 80)


def test_near_duplicates_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, " "), (4, "a b c d e f")], "doc_id long, text string")
    out = sorted(neardup.near_duplicates(df).collect(), key=repr)
    assert [(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id in (1, 4)] == [(1, 1, True), (1, 1, True), (4, 1, False)]
    assert all(r.kept for r in out if r.doc_id in (None, 2, 3)) and len(out) == 6
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want


# --- URLs -------------------------------------------------------------------------------------------------------------
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_urls_and_aliases(spark):
    rows = [
        (1, "https://a.com/en/1", '<link rel="canonical" href="https://b.fr/x">', "block"),
        (2, "http://b.fr/x/", "", "block"),
        (3, "http://c.fr/y", '<meta http-equiv="refresh" content="0; url=//www.b.fr/x">', "block"),
        (4, None, None, "allow"),
        (5, "com/en/", "", "allow"),
        (6, "http://d.fr/z/q", "<LINK href='../x' rel=canonical>", "allow"),
        (7, "http://Z.Example.COM/en/77?x#y", "<link rel=canonical href=/foo>", "allow"),
        (8, "http://z.example.com/foo", None, "allow"),
        (9, "http://e.fr/1", '<link rel="canonical" href="http://k.org/es/1">', "block"),
        (10, "http://f.fr/1", '<link rel="canonical" href="http://e.fr/1"><meta http-equiv=refresh content="1;url=http://x.net/de/1">', "allow"),
        (11, "http://notcom/en/1", "", "allow"),
        (12, "ftp://x.example.net/de/81", "", "block"),
    ]
    rows[8] = (*rows[8][:3], "allow")  # its component holds the allow rule that page 10 leads to
    df = spark.createDataFrame([r[:3] + ("k",) for r in rows], "page_id long, url string, html string, key string")
    got = {r.page_id: r for r in urlfilter.judge(df, RULES).collect()}
    assert {k: r.verdict for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert (got[7].host, got[7].path, got[7].rule) == ("z.example.com", "/en/77", "example.com/en/7") and got[12].rule == "example.net/de/8"
    assert (got[4].host, got[4].path, got[4].rule) == ("", "", None) and (got[5].host, got[5].path) == ("", "")
    assert urlfilter.judge(df.limit(0), RULES).count() == 0 and urlfilter.judge(df.union(df), RULES).count() == 2 * len(rows)


# --- tokens and packing -----------------------------------------------------------------------------------------------
SPECIAL = ["a <|endoftext|> b<|endoftext|>", "x  \n\n y  z  w", "don't DON'T it's,,, 12,000!? <|endoftext|", "  lead", "trail  ", "\ttab\n", "a.b;c:d", "日本語 テキスト　全角", "é \u0085 x"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts_are_the_librarys(spark):
    values = texts() + SPECIAL
    model = library()
    out = {r.doc_id: r for r in tokens.token_counts(documents(spark, values, clash=True), tokenizer_path(), limit=50).collect()}
    for i, t in enumerate(values):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 50), t
    assert tokens.token_counts(documents(spark).limit(0), tokenizer_path()).count() == 0


def thue_morse(n):
    """n letters, and the same with both letters exchanged; polynomial hashes modulo 2^64 take them for equal from 1024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_strings_that_collide_in_polynomial_hashes(spark):
    values = [t for n in (1024, 2048, 4096) for t in thue_morse(n)]
    model, docs = library(), documents(spark, values).coalesce(1)
    want = [len(model.encode(t, add_special_tokens=False).ids) for t in values]
    assert [r.n_tokens for r in tokens.token_counts(docs, tokenizer_path()).orderBy("doc_id").collect()] == want and want[0] != want[1]
    check_packing(packing.with_digest(packing.pack(docs, tokenizer_path())).collect(), values)
    assert [r.kept for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [True] * 6
    lines = ["\n".join(f"a b c d e f g h i {t}" for t in pair) for pair in (values[:2], values[1::-1], values[2:4])]
    assert [r.removed for r in linedup.line_overlaps(documents(spark, lines)).orderBy("doc_id").collect()] == [[], [0, 1], []]
    words = " ".join(f"{a} {b} {a} {a}" for a, b in (values[:2], values[2:4]))
    assert quality.features(documents(spark, [words])).first().n_repeat_words == 0


def test_other_vocabularies(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    values = texts()[:20] + SPECIAL[1:]
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    word = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for name, count in (("piece_bpe_32k.model", lambda t: len(piece.encode(t))), ("word_bpe_49k.json", lambda t: len(word.encode(t, add_special_tokens=False).ids))):
        out = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark, values), tokenizer_path(name)).collect()}
        assert out == {i: count(t or "") for i, t in enumerate(values)}


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 64)
    monkeypatch.setattr(tokens, "REMEMBERED_IDS", 100)
    model, values = library(), [t or "" for t in texts()]
    encoder = tokens.Encoder(*tokens.read_tokenizer(tokenizer_path()))
    got = []
    for _, _, raw, offsets in kernels.blocks(pa.array(values), 2000):
        ids, begin = encoder.encode(raw, offsets)
        got += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in values]


def check_packing(rows, values, window=1024):
    model = library()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(values):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_places_every_id_once(spark):
    values = texts() + SPECIAL + ["same text of one length " * 40] * 60
    assert check_packing(packing.with_digest(packing.pack(documents(spark, values, clash=True), tokenizer_path())).collect(), values) <= 3 * 8
    assert packing.pack(documents(spark).limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_fill_windows(seed):
    rng = np.random.default_rng(seed)
    histogram = [np.bincount(rng.integers(1, 1024, 20_000), minlength=1024), np.bincount([700] * 5000 + [10] * 3, minlength=1024), np.bincount(rng.integers(1, 1024, 30), minlength=1024), np.zeros(1024, dtype=int)][seed]
    rows, n = packing.plan(histogram, 1024)
    fill, ranks = Counter(), defaultdict(int)
    for tail, _, tokens_, _, count, sequence, _ in rows:
        ranks[tail] += tokens_ * count
        for j in range(count):
            fill[sequence + j] += tokens_
    assert all(ranks[k] == k * int(h) for k, h in enumerate(histogram)) and set(fill) == set(range(n))
    padding = sum(0 if x & (x - 1) == 0 else 1024 - x for x in fill.values())
    assert max(fill.values(), default=0) <= 1024 and padding <= 0.01 * sum(fill.values())


def test_least_squares_recovers_a_mixture():
    histogram = np.zeros(1024, dtype=int)
    for parts, n in (((1000, 24), 500), ((600, 400, 24), 300), ((512,), 200)):
        for p in parts:
            histogram[p] += n
    combos = packing.combinations(1024, histogram)
    x = packing.solve(combos, histogram)
    left = histogram.astype(float)
    for c, v in zip(combos, x):
        for p in c[c > 0]:
            left[p] -= v
    assert np.abs(left).max() < 1


# --- decontamination --------------------------------------------------------------------------------------------------
def brute_hits(values, items, window):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for k, t in items:
        w = re.findall(pattern, ascii_lower(t or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = {}
    for d, t in enumerate(values):
        w = re.findall(pattern, ascii_lower(t or ""))
        hit, found = set(), set()
        for n in set(map(len, windows)):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit))
    return out


def test_decontamination_matches_brute_force(spark):
    values = texts()
    items = [(i, " ".join((values[i] or "").split()[3:18])) for i in range(12)] + [(50, "two words"), (51, "x1"), (52, None), (53, ""), (54, "the of the of the of the of the of the of"), (0, "one"), (None, "Alpha beta")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("words", F.lit(2))
    out = decontam.contamination(documents(spark, clash=True), bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in out}
    assert got == brute_hits(values, items, 10)
    empty = decontam.contamination(documents(spark), bench.limit(0)).collect()
    assert len(empty) == len(values) and not any(r.contaminated for r in empty)
    assert decontam.contamination(documents(spark).limit(0), bench).count() == 0
    assert decontam.contamination(documents(spark).union(documents(spark)), bench).count() == 2 * len(values)


# --- licences ---------------------------------------------------------------------------------------------------------
def test_license_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    values = [mit, "Some prose.\nReleased under the MIT License.\nMore.", "// Licensed under the Apache License, Version 2.0\n// You may not use this file except in compliance with the License.", "Copyright 2020. All rights reserved.", "no licence here", None, "", "Licensed under CC BY-NC 4.0. This work is licensed under the\ngnu general public license, version 3.", "the software is provided as is, without warranty of any kind"]
    out = {r.doc_id: r for r in licenses.license_scan(documents(spark, values, clash=True)).collect()}
    assert [out[i].licenses for i in range(9)] == [["MIT"], ["MIT"], ["Apache-2.0"], ["Proprietary"], [], [], [], ["GPL-3.0-only", "CC-BY-NC-4.0"], []]
    assert out[0].identifiers == ["MitGrant", "MitNotice", "AsIs"] and out[0].unmatched == 0 and out[8].unmatched == 1
    assert licenses.license_scan(documents(spark).limit(0)).count() == 0
