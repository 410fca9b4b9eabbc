"""Line de-duplication finds every block of consecutive lines that an earlier document has."""

from __future__ import annotations

import random
import time

from quillstone.llm import linedup


def removed(spark, values):
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_lines, r.removed, r.n_removed_words) for r in linedup.line_overlaps(docs).collect()}


def test_common_lines_and_short_lines_go(spark):
    common = "\n".join("line %d of a passage that all documents hold" % i for i in range(3))  # 9 words a line
    short = "\n".join(["one two three", "four five", "", "six seven eight", "nine ten"])
    values = [f"{common}\nown {i}" for i in range(1100)] + [f"own a\n{short}", f"{short}\nown b"]
    out = removed(spark, values)
    assert out[0] == (4, [], 0) and all(out[i] == (4, [0, 1, 2], 27) for i in range(1, 1100))
    assert out[1100] == (6, [], 0) and out[1101] == (6, [0, 1, 2, 3, 4], 10)


def brute(values, least_words=10):
    """Lines of all common blocks with an earlier document, from every pair of places."""
    lines = [[tuple(x.lower().split()) for x in v.split("\n")] for v in values]
    out = {}
    for d, mine in enumerate(lines):
        gone = set()
        for other in lines[:d]:
            for i in range(len(mine)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                        n += 1
                    if sum(map(len, mine[i : i + n])) >= least_words:
                        gone |= set(range(i, i + n))
        out[d] = (len(mine), sorted(gone), sum(len(mine[i]) for i in gone))
    return out


def test_repeated_and_exchanged_passages_go(spark):
    first, second = ("\n".join(f"{name} passage line {i} with these words in it" for i in range(2)) for name in ("first", "second"))
    values = [f"own a\n{first}\nown b\n{second}\nown c", f"{first}\nown d\n{first}", f"{second}\nown e\n{first}", f"own f\n{second}\nown g\n{second}\n{first}\n{first}"]
    out = removed(spark, values)
    assert out == brute(values)
    assert out[0][1] == [] and out[1][1] == [0, 1, 3, 4] and out[2][1] == [0, 1, 3, 4] and out[3][1] == [1, 2, 4, 5, 6, 7, 8, 9]


def test_blocks_match_brute_force(spark):
    rng = random.Random(8)
    kinds = ["", "a", "b c", "d e f", "G h  i j", "k l m n o", " \t", "p q r s t u v w x y z"]
    values = ["\n".join(rng.choice(kinds[: rng.choice([4, 8])]) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    assert removed(spark, values) == brute(values)


def test_many_lines_go_in_proportion(spark):
    text = "\n".join(f"line {i} has some words of its own {i * 7919 % 1_000_003}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, f"first line\n{text}\nlast line")], "doc_id long, text string").repartition(2)
    began = time.time()
    left = {r.doc_id: r.text for r in linedup.remove_lines(docs, linedup.line_overlaps(docs)).collect()}
    assert left == {1: text, 2: "first line\nlast line"} and time.time() - began < 60
