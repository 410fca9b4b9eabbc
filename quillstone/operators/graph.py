"""Operators over directed graphs: vertices (id) and edges (src, dst).

Loops write each round to the shared folder, so plans stay short and any executor may be lost. A
round is joins and grouped aggregates over edges; nothing is gathered but a count or a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.sources.tables import apart, fresh_path, keep, sized


def links(edges: DataFrame) -> DataFrame:
    """Different edges without self-edges."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree: different neighbours, zero where there are none."""
    e = links(edges)
    ins = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    outs = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    out = vertices.select("id").join(ins, "id", "left").join(outs, "id", "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, out_links, in_links, each distinct and sorted."""
    e = links(edges)
    outs = e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("out_links"))
    ins = e.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("in_links"))
    none = F.array().cast(outs.schema["out_links"].dataType)
    return outs.join(ins, "id", "full").select("id", F.coalesce("out_links", none).alias("out_links"), F.coalesce("in_links", none).alias("in_links"))


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an edge to or from another."""
    return degrees(vertices, edges).where("in_degree = 0 AND out_degree = 0").select("id")


def _numbers(column: pa.Array | pa.ChunkedArray, kind: str = "f8") -> list[np.ndarray]:
    """Arrays that a column of packed numbers holds."""
    return [np.frombuffer(x.as_py(), kind) for x in column]


def _blocks(placed: DataFrame, size: int, keys: list[list[int]]) -> DataFrame:
    """Different links (v, w: numbers of their ends) by pairs of runs of vertices, packed: at (the key of a block of such pairs),
    qs, qd, s, d (places within runs), and how many rows a pair had."""
    side = len(keys)
    parted = placed.select(*(F.expr(f"CAST({v} {o} {size} AS INT) AS {c}") for v, o, c in (("v", "DIV", "qs"), ("w", "DIV", "qd"), ("v", "%", "s"), ("w", "%", "d"))))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        qs, qd = (k.as_py() for k in key)
        s, d = (rows.column(c).to_numpy().astype("i8") for c in ("s", "d"))
        pairs = np.unique(s * size + d)
        s, d = ((x).astype("i4").tobytes() for x in (pairs // size, pairs % size))
        return pa.table({"at": pa.array([keys[qd % side][qs % side]], pa.int32()), "qs": pa.array([qs], pa.int32()), "qd": pa.array([qd], pa.int32()), "s": [s], "d": [d], "n_rows": pa.array([len(rows)], pa.int64())})

    return parted.groupBy("qs", "qd").applyInArrow(pack, "at int, qs int, qd int, s binary, d binary, n_rows long")


def _block_keys(spark, side: int) -> list[list[int]]:
    """side x side numbers that a shuffle by hash deals to as many different partitions."""
    parts = side * side
    dealt = spark.range(64 * parts).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(parts)).alias("p")).agg(F.min("x").alias("x"))
    first = [r["x"] for r in dealt.sort("p").collect()]  # one for each partition
    return [first[i * side : (i + 1) * side] for i in range(side)]


def _homes(packed: DataFrame, runs: int, keys: list[int]) -> Callable[[Column], Column] | None:
    """The block of a run if links are dealt by ranges of the runs they lead to, where that sends fewer runs in a step than the square
    does and no block gets more than twice its share of links; else None."""
    home = lambda q: F.array(*map(F.lit, keys))[(q.cast("long") * len(keys) / max(runs, 1)).cast("int")]
    told = packed.select("at", "qs", "qd", "n_rows", home(F.col("qd")).alias("to"), home(F.col("qs")).alias("own"))
    alone = told.where("own <> `to`").select("qs", "to").distinct().count() + runs
    square = told.select("qs", "at").distinct().count() + told.select("qd", "at").distinct().count()
    fullest, total = told.groupBy("to").agg(F.sum("n_rows").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return home if total and alone < square and fullest * len(keys) <= 2 * total else None


#: Vertices of a run, whose numbers are packed together, at most; sides of the square of blocks over which edges are dealt.
RUN, SIDE = 1 << 18, 4
#: Relative change of a vertex from which a wave counts as a multiple of the one before.
SETTLED = 1e-13
#: Passes over a graph that merge cycles, rounds of a pass, the round from which ever fewer vertices must move, and the share of
#: vertices that must be left for another pass to follow.
PASSES, ROUNDS, EARLY, WORTH = 8, 24, 8, 0.01
#: Links that numbers go on over within a block and round, at most.
WITHIN = 64
#: Members of walks after which a task passes on what it has.
MEMBERS_AT_ONCE = 1 << 15


@dataclass
class Dealt:
    """A graph in packed form: numbered vertices by runs, links dealt over blocks. Steps over it send numbers of vertices to the
    blocks that have links of theirs, never links."""

    ids: DataFrame  #: id, v: its place by id, from 0
    n: int
    size: int  #: vertices of a run
    blocks: DataFrame  #: at, qs, qd, s, d
    routes: DataFrame  #: q, is_in, at: the blocks that have links from a run, or (is_in) to it; kept, some rows a run
    edges: DataFrame  #: as given
    whole: bool  #: whether all links have both ends among the vertices
    homes: Column | None  #: of a run q: the block that has all links to it, where links are dealt like that

    @cached_property
    def degrees(self) -> DataFrame:
        """id, v, in_degree, out_degree, as degrees() counts them."""
        if not self.whole:
            return keep(self.ids.join(degrees(self.ids, self.edges), "id"))
        n, size = self.n, self.size

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, bool], np.ndarray] = {}
            for batch in batches:
                for i in range(len(batch)):
                    row = batch.slice(i, 1)
                    for end, run, is_in in (("s", "qs", False), ("d", "qd", True)):
                        q = row.column(run)[0].as_py()
                        got = np.bincount(_numbers(row.column(end), "i4")[0], minlength=min(size, n - q * size)).astype("i4")
                        sums[q, is_in] = sums[q, is_in] + got if (q, is_in) in sums else got
            for (q, is_in), x in sums.items():
                yield pa.RecordBatch.from_pydict({"q": pa.array([q], pa.int32()), "is_in": [is_in], "x": [x.tobytes()]})

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            q = key[0].as_py()
            sums = np.zeros((2, min(size, n - q * size)), "i8")
            for is_in, x in zip(rows.column("is_in").to_pylist(), _numbers(rows.column("x"), "i4"), strict=True):
                sums[int(is_in)] += x
            return pa.table({"v": np.arange(sums.shape[1], dtype="i8") + q * size, "in_degree": sums[1], "out_degree": sums[0]})

        found = self.blocks.mapInArrow(count, "q int, is_in boolean, x binary").groupBy("q").applyInArrow(add, "v long, in_degree long, out_degree long")
        return keep(self.ids.join(apart(found), "v", "left").select("id", "v", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree"))))


@contextmanager
def dealt(vertices: DataFrame, edges: DataFrame) -> Iterator[Dealt]:
    """The graph in packed form, for any number of steps within the block. Edges should be kept, since they are read twice; equal ones count
    once. Integer ids without a gap are their own numbers, so links are placed without a join.

    Links are dealt over a square of blocks by both of their ends, or by ranges of the runs that they lead to where that sends less, as
    it does where most links join vertices that lie close together by id.
    """
    spark = vertices.sparkSession
    ids = keep(vertices.select("id").distinct())
    is_integer = ids.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    e = edges.where("src <> dst").select("src", "dst")
    low, high, n, known = ids.agg(F.min("id"), F.max("id"), F.count("*"), F.count("id")).first()
    if is_integer and n and n == known == high - low + 1:
        number = lambda c: F.col(c).cast("long") - F.lit(low).cast("long")
        ids = ids.select("id", number("id").alias("v"))
        placed = e.where(F.col("src").between(low, high) & F.col("dst").between(low, high)).select(number("src").alias("v"), number("dst").alias("w"))
    else:
        ids = keep(rank_rows(ids, ["id"], "v").select("id", (F.col("v") - 1).alias("v")))
        placed = e.join(apart(ids.withColumnRenamed("id", "src")), "src").join(apart(ids.selectExpr("id AS dst", "v AS w")), "dst").select("v", "w")
    size = min(RUN, max(1024, -(-n // 64)))
    keys = _block_keys(spark, SIDE)
    packed = keep(_blocks(placed, size, keys))
    whole = (packed.agg(F.sum("n_rows")).first()[0] or 0) == e.count()
    homes = _homes(packed, -(-n // size), [k for row in keys for k in row])
    if homes is not None:
        packed = packed.withColumn("at", homes(F.col("qd")))
    routes = keep(packed.select(F.explode(F.array(*(F.struct(F.col(c).alias("q"), F.lit(is_in).alias("is_in"), "at") for c, is_in in (("qs", False), ("qd", True))))).alias("r")).select("r.*").distinct())
    blocks = packed.drop("n_rows").repartition(SIDE * SIDE, "at").persist()
    try:
        yield Dealt(ids, n, size, blocks, routes, edges, whole, None if homes is None else homes(F.col("q")))
    finally:
        blocks.unpersist()


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = C.PAGERANK_ITERATIONS, epsilon: float | None = C.PAGERANK_EPSILON, digits: int = 6, graph: Dealt | None = None) -> DataFrame:
    """id, page_rank. Ranks begin at 1/n; each round gives every vertex (1 - d)/n + d * dangling/n and, undamped, the
    rank of each predecessor divided by its links. Mass grows within cycles by design, so the number of
    rounds counts. Ends after ``iterations``, or when ranks change by less than ``epsilon`` in all.
    Links to what is no vertex carry their share away.

    What a round adds to all vertices alike moves on along the links like what any other round added. So only the unit waves are
    computed over the graph: what a vertex gets after k steps where every vertex sent 1. All rounds' ranks are sums of waves
    with weights that follow from one number per wave (its part on vertices without links); how far ranks move in each round is
    summed up in one pass. Waves end where none is left, where a bound of what ranks move by is below epsilon, or where a wave is
    a multiple of the one before: c' = r c + d. All later ones are then multiples, too, since a step adds up shares: where
    |d| <= SETTLED * c they differ by that part a step, and the rest of d never grows in sum, so it is held so small that no
    rank moves by 10^-12.

    Vertices are numbered and packed by runs; edges stay dealt over blocks, in packed form. Over a square, a step sends each run to a
    row of blocks and adds up the sums of a column: 2 * SIDE numbers move for each vertex at most, however many edges it has. Where
    a block has all links to its runs, they are sent to it and come out with their sums. ``graph`` is the same graph as dealt() gives it, where other steps use it as well.
    """
    if graph is None:
        with dealt(vertices, keep(edges.select("src", "dst"))) as graph:
            return pagerank(vertices, edges, iterations, epsilon, digits, graph)
    spark, ids, n, size, blocks = vertices.sparkSession, graph.ids, graph.n, graph.size, graph.blocks
    if not n:
        return ids.select("id", F.lit(0.0).alias("page_rank"))
    outs = graph.degrees.select("v", F.col("out_degree").alias("n_out"))

    def begin(key: tuple, rows: pa.Table) -> pa.Table:
        q = key[0].as_py()
        n_out = np.zeros(min(size, n - q * size), "i4")
        n_out[rows.column("o").to_numpy()] = rows.column("n_out").to_numpy()
        return packed(q, np.ones(len(n_out)), n_out, 0.0)

    def packed(q: int, c: np.ndarray, n_out: np.ndarray, far: float) -> pa.Table:
        return pa.table({"q": pa.array([q], pa.int32()), "c": [c.tobytes()], "n_out": [n_out.tobytes()], "mass": [float(c.sum())], "ended": [float(c[n_out == 0].sum())], "far": [far]})

    def pushed(edges: pa.Table, sent: pa.Table) -> dict[int, np.ndarray]:
        shares = {q: c / np.maximum(k, 1) for q, c, k in zip(sent.column("q").to_pylist(), _numbers(sent.column("c")), _numbers(sent.column("n_out"), "i4"), strict=True)}
        sums: dict[int, np.ndarray] = {}
        for i in range(len(edges)):
            row = edges.slice(i, 1)
            q = row.column("qd")[0].as_py()
            s, d = _numbers(row.column("s"), "i4")[0], _numbers(row.column("d"), "i4")[0]
            got = np.bincount(d, weights=shares[row.column("qs")[0].as_py()][s], minlength=min(size, n - q * size))
            sums[q] = sums[q] + got if q in sums else got
        return sums

    def push(edges: pa.Table, sent: pa.Table) -> pa.Table:
        sums = pushed(edges, sent)
        return pa.table({"q": pa.array(list(sums), pa.int32()), "c": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    def after(before: pa.Table, parts: list[np.ndarray], ratio: float) -> pa.Table:
        last, n_out = _numbers(before.column("c"))[0], _numbers(before.column("n_out"), "i4")[0]
        c = sum(parts, np.zeros(len(last)))
        apart = np.abs(c - ratio * last)
        return packed(before.column("q")[0].as_py(), c, n_out, float(apart[apart > SETTLED * last].sum()))

    def add(ratio: float):
        return lambda parts, before: after(before, _numbers(parts.column("c")), ratio)

    def at_home(ratio: float):
        def step(edges: pa.Table, sent: pa.Table) -> pa.Table:
            sums, own = pushed(edges, sent), [i for i, x in enumerate(sent.column("is_own").to_pylist()) if x]
            rows = [sent.slice(i, 1) for i in own]
            found = [after(row, [sums[q]] if (q := row.column("q")[0].as_py()) in sums else [], ratio) for row in rows]
            return pa.concat_tables(found) if found else pa.table({f.name: pa.array([], f.type) for f in packed(0, np.zeros(0), np.zeros(0, "i4"), 0.0).schema})

        return step

    folder, schema = fresh_path(spark), "q int, c binary, n_out binary, mass double, ended double, far double"
    wave = outs.select(F.expr(f"CAST(v DIV {size} AS INT) AS q"), F.expr(f"CAST(v % {size} AS INT) AS o"), F.coalesce("n_out", F.lit(0)).cast("int").alias("n_out")).groupBy("q").applyInArrow(begin, schema)
    to = graph.routes.where("NOT is_in").select("q", "at")
    if graph.homes is not None:
        runs = spark.range(-(-n // size)).select(F.col("id").cast("int").alias("q"))
        to = to.withColumn("is_own", F.lit(False)).union(runs.select("q", graph.homes.alias("at"), F.lit(True))).groupBy("q", "at").agg(F.max("is_own").alias("is_own"))
    to = F.broadcast(keep(to))  # some rows a run
    mass, ended = [], []
    ratio, weights = 1.0, np.zeros((iterations + 1, iterations + 1))  # by round, of each wave
    weights[0, 0] = 1 / n
    for k in range(iterations + 1):
        if k:
            sent = wave.drop("mass", "ended", "far").join(to, "q")
            if graph.homes is not None:
                wave = blocks.groupBy("at").cogroup(sent.groupBy("at")).applyInArrow(at_home(ratio), schema)
            else:
                parts = blocks.groupBy("at").cogroup(sent.groupBy("at")).applyInArrow(push, "q int, c binary")
                wave = parts.groupBy("q").cogroup(wave.groupBy("q")).applyInArrow(add(ratio), schema)
        got = Observation()
        wave.observe(got, *(F.sum(c).alias(c) for c in ("mass", "ended", "far"))).write.parquet(f"{folder}/k={k}")
        wave = spark.read.schema(schema).parquet(f"{folder}/k={k}")
        mass.append(got.get["mass"])
        ended.append(got.get["ended"])
        if k:
            weights[k, 1:] = weights[k - 1, :-1]
            weights[k, 0] = (1 - C.DAMPING) / n + C.DAMPING * float(weights[k - 1, :k] @ np.array(ended[:k])) / n
            is_still = epsilon is not None and float(np.abs(weights[k, : k + 1] - weights[k - 1, : k + 1]) @ np.array(mass)) < epsilon
            heaviest = float(weights[: k + 1].max()) * iterations * iterations
            if not mass[k] or is_still or (k > 1 and heaviest * got.get["far"] < 1e-12):
                break
            ratio = mass[k] / mass[k - 1]
    # wave i after the last one is the last one times ratio^(i - k), and rounds after it follow from these
    ratio = mass[k] / mass[k - 1] if k and mass[k - 1] else 0.0
    power = np.array([ratio ** max(i - k, 0) for i in range(iterations + 1)])
    ended = np.array([ended[min(i, k)] for i in range(iterations + 1)]) * power
    for t in range(k + 1, iterations + 1):
        weights[t, 1:] = weights[t - 1, :-1]
        weights[t, 0] = (1 - C.DAMPING) / n + C.DAMPING * float(weights[t - 1] @ ended) / n
    weights = np.hstack([weights[:, :k], (weights[:, k:] * power[k:]).sum(axis=1, keepdims=True)])
    waves = spark.read.schema(f"{schema}, k int").parquet(folder).select("q", "k", "c")  # a run has as many rows as waves

    def by_wave(rows: pa.Table) -> Iterator[np.ndarray]:
        """Vertices of a run with their numbers in all waves, some at a time."""
        of = dict(zip(rows.column("k").to_pylist(), _numbers(rows.column("c")), strict=True))
        for at in range(0, len(of[0]), 1 << 14):
            yield np.stack([of[i][at : at + (1 << 14)] for i in range(k + 1)], axis=1)

    last = iterations
    if epsilon is not None:
        steps = np.diff(weights, axis=0).T  # by wave, how its weight changes in each round

        def moved(rows: pa.Table) -> pa.Table:
            total = sum(np.abs(own @ steps).sum(axis=0) for own in by_wave(rows))
            return pa.table({"t": pa.array(np.arange(1, len(total) + 1), pa.int32()), "by": total})

        by = {r["t"]: r["by"] for r in waves.groupBy("q").applyInArrow(moved, "t int, by double").groupBy("t").agg(F.sum("by").alias("by")).collect()}
        last = next((t for t in sorted(by) if by[t] < epsilon), iterations)
    final = weights[last]

    def ranks(key: tuple, rows: pa.Table) -> pa.Table:
        r = np.concatenate([own @ final for own in by_wave(rows)])
        return pa.table({"v": np.arange(len(r), dtype="i8") + key[0].as_py() * size, "r": r})

    return ids.join(waves.groupBy("q").applyInArrow(ranks, "v long, r double"), "v").select("id", F.round("r", digits).alias("page_rank"))


def furthest(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id and colour, the largest id that reaches a vertex over edges (src, dst), itself included.

    Each round takes the colours of three others: of all predecessors, of the vertex that is one's
    colour, and of the vertex that lies 2, 4, 8, ... steps back along one chosen predecessor each. So a path or
    cycle of n vertices takes about log2(n) rounds; the result doesn't depend on the choice, since a round
    that changes nothing ends the loop.
    """
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.max_by("src", F.xxhash64("src")).alias("behind"))
    now = keep(ids.join(apart(back), "id", "left").select("id", F.col("id").alias("colour"), "behind"))
    seen = None
    while True:
        at = lambda key, *more: apart(now.select(F.col("id").alias(key), *more))
        jump = now.join(at("colour", F.col("colour").alias("c1")), "colour", "left").join(at("behind", F.col("colour").alias("c2"), F.col("behind").alias("next")), "behind", "left")
        push = edges.join(at("src", "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("c3"))
        now = keep(jump.join(apart(push), "id", "left").select("id", F.greatest("colour", "c1", "c2", "c3").alias("colour"), F.col("next").alias("behind")))
        mark = now.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))).first()[0]
        if mark == seen:
            return now.select("id", "colour")
        seen = mark


def _by_colours(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components: id, component (its smallest member), by joins over edges.

    The largest id that reaches a vertex is its colour, and within a colour, the vertices from which in turn the
    colour's own vertex is the largest that they reach are its component. Both are furthest(), once along the
    edges and once against them. Vertices without an edge in or out of what is left are components of
    their own and go first. Rounds follow the logarithm of the longest chain, work per round the edges.
    """
    left = keep(vertices.select("id").distinct())
    e = keep(links(edges))
    done: DataFrame | None = None

    def add(found: DataFrame) -> None:
        nonlocal done
        done = found if done is None else done.union(found)

    while not left.isEmpty():
        for _ in range(3):
            core = keep(e.select(F.col("src").alias("id")).distinct().join(apart(e.select(F.col("dst").alias("id")).distinct()), "id", "left_semi"))
            add(keep(left.join(apart(core), "id", "left_anti").select("id", F.col("id").alias("root"))))
            before = e.count()
            left = core
            e = keep(e.join(apart(core.withColumnRenamed("id", "src")), "src", "left_semi").join(apart(core.withColumnRenamed("id", "dst")), "dst", "left_semi"))
            if e.count() == before:
                break
        if left.isEmpty():
            break
        colour = furthest(left, e)
        inner = keep(e.join(apart(colour.withColumnRenamed("id", "src").withColumnRenamed("colour", "a")), "src").join(apart(colour.withColumnRenamed("id", "dst").withColumnRenamed("colour", "b")), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = furthest(left, inner).withColumnRenamed("colour", "reached")
        found = keep(colour.join(apart(reached), "id").where("colour = reached").select("id", F.col("colour").alias("root")))
        add(found)
        rest = left = keep(left.join(apart(found), "id", "left_anti"))
        e = keep(e.join(apart(rest.withColumnRenamed("id", "src")), "src", "left_semi").join(apart(rest.withColumnRenamed("id", "dst")), "dst", "left_semi"))
    if done is None:
        return vertices.select("id", F.col("id").alias("component")).limit(0)
    low = done.groupBy("root").agg(F.min("id").alias("component"))
    return done.join(apart(low), "root").select("id", "component")


def contract(graph: Dealt) -> tuple[DataFrame, DataFrame, bool]:
    """Merges vertices that lie on common cycles, without moving links: id and label (equal ones are in one component, not always all
    of it), the different links left between labels (a, b, is_open), and whether only open ones can lie on cycles.

    Vertices get numbers in a mixed order. In each round a vertex takes the largest number that its predecessors have heard of, and of those
    that its successors have. What it has heard of from ahead lies on a way to it, from behind on a way from it: where both are the same,
    it is in that vertex's component, however few rounds there were. The others go on in a next pass, each among those that
    heard the same. A component is never split by that if the pass ended by itself; then those found are also complete.
    Within a block numbers go on from link to link, so rounds follow the blocks that a way leads through where links are dealt by ranges of runs.
    2 * SIDE short numbers a vertex and direction move in a round at most, most of them alike, so that they compress. A pass ends early where as many numbers move
    in a round as in the one before, as along chains; what is left is up to the caller.
    """
    spark, n, size = graph.ids.sparkSession, graph.n, graph.size
    step = next(a for a in range(int(n * 0.618) | 1, 3 * n + 3) if gcd(a, n) == 1)
    schema = "q int, f binary, b binary, kind binary, label binary, moved long, left long"

    def packed(q: int, f: np.ndarray, b: np.ndarray, kind: np.ndarray, label: np.ndarray, moved: int, left: int) -> pa.Table:
        arrays = {c: [x.astype("i4").tobytes()] for c, x in (("f", f), ("b", b), ("kind", kind), ("label", label))}
        return pa.table({"q": pa.array([q], pa.int32()), **arrays, "moved": pa.array([moved], pa.int64()), "left": pa.array([left], pa.int64())})

    def own(q: int) -> np.ndarray:
        return ((np.arange(min(size, n - q * size), dtype="i8") + q * size) * step % n).astype("i4")

    def of(row: pa.Table) -> list[np.ndarray]:
        return [_numbers(row.column(c), "i4")[0] for c in ("f", "b", "kind", "label")]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column("q").to_pylist():
                mine = own(q)
                yield from packed(q, mine, mine, np.zeros(len(mine)), np.full(len(mine), -1), 0, 0).to_batches()

    def push(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        has = {(q, is_in): (x, kind) for q, is_in, x, kind in zip(sent.column("q").to_pylist(), sent.column("is_in").to_pylist(), _numbers(sent.column("x"), "i4"), _numbers(sent.column("kind"), "i4"), strict=True)}
        known = {(q, not is_in): x.copy() for (q, is_in), (x, _) in has.items()}  # by run and whether it came from ahead
        known |= {key: np.full(len(x), -1, "i4") for key, (x, _) in has.items() if key not in known}
        found = []
        for i in range(len(pairs)):
            row = pairs.slice(i, 1)
            qs, qd = row.column("qs")[0].as_py(), row.column("qd")[0].as_py()
            s, d = _numbers(row.column("s"), "i4")[0], _numbers(row.column("d"), "i4")[0]
            of_src, of_dst = has[qs, False][1][s], has[qd, True][1][d]
            alike = (of_src == of_dst) & (of_src >= 0)
            found += [(known[qs, True], s[alike], known[qd, True], d[alike]), (known[qd, False], d[alike], known[qs, False], s[alike])]
        for _ in range(WITHIN):
            is_still = True
            for x, at, y, to in found:
                more = x[at] > y[to]
                if more.any():
                    np.maximum.at(y, to[more], x[at[more]])
                    is_still = False
            if is_still:
                break
        return pa.table({"q": pa.array([q for q, _ in has], pa.int32()), "is_in": pa.array([i for _, i in has], pa.bool_()), "x": pa.array([known[key].tobytes() for key in has], pa.binary())})

    def add(parts: pa.Table, before: pa.Table) -> pa.Table:
        f, b, kind, label = of(before)
        new = {True: f.copy(), False: b.copy()}
        for is_in, x in zip(parts.column("is_in").to_pylist(), _numbers(parts.column("x"), "i4"), strict=True):
            np.maximum(new[is_in], x, out=new[is_in])
        done = label >= 0
        new[True][done] = new[False][done] = -1
        return packed(before.column("q")[0].as_py(), new[True], new[False], kind, label, int(((new[True] != f) | (new[False] != b)).sum()), 0)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                q = row.column("q")[0].as_py()
                f, b, kind, label = of(row)
                mine, found = own(q), (label < 0) & (f == b)
                label = np.where(found, f, label)
                mixed = (f.astype("i8") * 1_000_003 + b) * 998_244_353 + kind.astype("i8") * 69_069
                kind = np.where(label < 0, (mixed ^ (mixed >> 29)) & 0x7FFFFFFF, -1)
                start = np.where(label < 0, mine, -1)
                yield from packed(q, start, start, kind, label, 0, int((label < 0).sum())).to_batches()

    def sent(state: DataFrame, f: str, b: str) -> DataFrame:
        """To all blocks that hold links from a run what is known of it from ahead (f), to those with links to it from behind (b)."""
        to = F.broadcast(graph.routes)  # some rows a run
        return state.select("q", F.col(f).alias("f"), F.col(b).alias("b"), "kind").join(to, "q").select("at", "q", "is_in", F.when(F.col("is_in"), F.col("b")).otherwise(F.col("f")).alias("x"), "kind")

    def written(df: DataFrame, what: str) -> tuple[DataFrame, int]:
        got, path = Observation(), fresh_path(spark)
        df.observe(got, F.sum(what).alias("x")).write.parquet(path)
        return spark.read.schema(schema).parquet(path), got.get["x"] or 0

    state, _ = written(spark.range(-(-n // size)).select(F.col("id").cast("int").alias("q")).mapInArrow(begin, schema), "moved")
    is_exact = True
    for _ in range(PASSES):
        before = n
        for k in range(1, ROUNDS + 1):
            parts = graph.blocks.groupBy("at").cogroup(sent(state, "f", "b").groupBy("at")).applyInArrow(push, "q int, is_in boolean, x binary")
            state, moved = written(parts.groupBy("q").cogroup(state.groupBy("q")).applyInArrow(add, schema), "moved")
            if not moved or (k >= EARLY and moved > max(0.1 * n, 0.8 * before)):
                break
            before = moved
        is_exact = is_exact and not moved
        state, rest = written(state.mapInArrow(settle, schema), "left")
        if not is_exact or rest < WORTH * n:  # a pass that merges none still tells apart what the next one merges
            break

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q, label = batch.column("q")[i].as_py(), _numbers(batch.column("label").slice(i, 1), "i4")[0]
                yield pa.RecordBatch.from_pydict({"v": np.arange(len(label), dtype="i8") + q * size, "label": np.where(label < 0, own(q), label).astype("i8")})

    def left(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        has = {}
        for q, is_in, label, kind in zip(sent.column("q").to_pylist(), sent.column("is_in").to_pylist(), _numbers(sent.column("x"), "i4"), _numbers(sent.column("kind"), "i4"), strict=True):
            has[q, is_in] = np.where(label < 0, own(q), label).astype("i8"), kind
        found = [np.zeros(0, "i8")]
        for i in range(len(pairs)):
            row = pairs.slice(i, 1)
            s, d = _numbers(row.column("s"), "i4")[0], _numbers(row.column("d"), "i4")[0]
            (a, of_src), (b, of_dst) = has[row.column("qs")[0].as_py(), False], has[row.column("qd")[0].as_py(), True]
            a, b, is_open = a[s], b[d], (of_src[s] == of_dst[d]) & (of_src[s] >= 0)
            found.append(np.unique((a * n + b)[a != b] * 2 + is_open[a != b]))
        found = np.unique(np.concatenate(found))
        return pa.table({"a": found // 2 // n, "b": found // 2 % n, "is_open": found % 2 == 1})

    labels = keep(graph.ids.join(apart(state.mapInArrow(named, "v long, label long")), "v").select("id", "label"))
    between = graph.blocks.groupBy("at").cogroup(sent(state, "label", "label").groupBy("at")).applyInArrow(left, "a long, b long, is_open boolean")
    return labels, keep(between.distinct()), is_exact


def components(graph: Dealt) -> tuple[DataFrame, DataFrame]:
    """Strongly connected components (id, component: its smallest member), and links (src, dst) that join the same components as
    all links do; where most vertices lie on cycles, these are few.

    Cycles are merged in packed form first; joins over edges only do what that leaves.
    """
    if not graph.whole or not graph.n or graph.n >= 1 << 30:
        e = keep(links(graph.edges))
        return keep(_by_colours(graph.ids.select("id"), e)), e
    labels, short, is_exact = contract(graph)
    e = keep((short.where("is_open") if is_exact else short).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = _by_colours(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)
    of = keep(labels.join(apart(found.select(F.col("id").alias("label"), F.col("component").alias("root"))), "label", "left").select("id", "label", F.coalesce("root", "label").alias("root")))
    parts = keep(of.join(apart(of.groupBy("root").agg(F.min("id").alias("component"))), "root").select("id", "component"))
    member = of.groupBy("label").agg(F.min("id").alias("id"))
    ends = short.join(apart(member.selectExpr("label AS a", "id AS src")), "a").join(apart(member.selectExpr("label AS b", "id AS dst")), "b")
    return parts, keep(ends.select("src", "dst"))


def scc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components: id, component (its smallest member)."""
    with dealt(vertices, keep(edges.select("src", "dst"))) as graph:
        return components(graph)[0]


def internal_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """component, edge_count: edges with both ends in one component."""
    e = links(edges).join(parts.withColumnRenamed("id", "src").withColumnRenamed("component", "a"), "src").join(parts.withColumnRenamed("id", "dst").withColumnRenamed("component", "b"), "dst")
    return e.where("a = b").groupBy(F.col("a").alias("component")).agg(F.count("*").alias("edge_count"))


def component_count(parts: DataFrame) -> DataFrame:
    """n_components: strongly connected components, single vertices included."""
    return parts.agg(F.countDistinct("component").alias("n_components"))


def cycles(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of two or more: cycle_rank, component, size, edge_count, by edges, then by the smallest member."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    out = sizes.join(internal_edges(parts, edges), "component")
    return rank_rows(out, [F.desc("edge_count"), F.col("component")], "cycle_rank").select("cycle_rank", "component", "size", "edge_count")


def _walk(begin: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The order in which a walk takes the members 0, 1, ... of a component, where to[begin[i] : begin[i + 1]] are member i's
    successors, ascending."""
    n = len(begin) - 1
    seen, order, ends = bytearray(n), np.empty(n, "i4"), memoryview(begin)
    is_seen, at, least = np.frombuffer(seen, "u1"), 0, 0
    for k in range(n):
        seen[at] = 1
        order[k] = at
        own = to[ends[at] : ends[at + 1]]
        if len(own) > 64:
            own = own[is_seen[own] == 0][:1]
        at = next((i for i in own.tolist() if not seen[i]), -1)
        if at < 0:
            at = least = seen.find(0, least)  # none after the last step
    return order


def _walks(batches: Iterator[pa.RecordBatch], largest: int | None) -> Iterator[pa.RecordBatch]:
    """component and path from rows (component, src, dst) in this order, where a member's row without a dst comes before those of its links;
    some MEMBERS_AT_ONCE at a time, or one component."""
    now, held, n_rows = None, [], 0  # the component at hand; by batch its members, the places of their rows, and links; its rows
    names, paths, n = [], [], 0

    def add() -> None:
        nonlocal n
        ids = pa.concat_arrays([x for x, _, _ in held])
        if len(ids) < 2:
            return
        names.append(now)
        if largest is not None and len(ids) > largest:
            paths.append(None)
            return
        begin = np.concatenate([*(x for _, x, _ in held), [n_rows]]) - np.arange(len(ids) + 1)
        to = pc.index_in(pa.chunked_array([x for _, _, x in held]), value_set=ids).to_numpy()
        paths.append(ids.take(pa.array(_walk(begin, to))))
        n += len(ids)

    def packed() -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(0 if x is None else len(x) for x in paths)]), pa.int32())
        values = pa.concat_arrays([pa.nulls(0, kind), *(x for x in paths if x is not None)])
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.ListArray.from_arrays(ends, values, mask=pa.array([x is None for x in paths]))], ["component", "path"])

    for batch in batches:
        if not len(batch):
            continue
        component, src, dst = batch.columns
        kind, is_member = src.type, dst.is_null()
        starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(component[1:], component[:-1]).to_numpy(zero_copy_only=False)) + 1])
        stops = np.append(starts[1:], len(batch))
        more = stops - starts > 1  # within a batch, one row is a vertex by itself
        more[[0, -1]] = True
        for a, b in zip(starts[more].tolist(), stops[more].tolist(), strict=True):
            name = component[a].as_py()
            if held and name != now:
                add()
                held, n_rows = [], 0
                if n >= MEMBERS_AT_ONCE:
                    yield packed()
                    names, paths, n = [], [], 0
            now, member = name, is_member[a:b]
            held.append((src[a:b].filter(member), np.flatnonzero(member.to_numpy(zero_copy_only=False)) + n_rows, dst[a:b].drop_null()))
            n_rows += b - a
    if held:
        add()
    if names:
        yield packed()


def cycle_paths(parts: DataFrame, edges: DataFrame, largest: int | None = None) -> DataFrame:
    """component and path: a walk through every component of two or more, from the smallest member to the smallest
    unvisited successor within it, or else to the smallest unvisited member.

    A walk depends on all its steps and its path is one row, so a component is walked in one task. That gets members and links
    sorted, some at a time, and holds a component's links as an id and a number each. A component may have as many
    members as a row can hold (2 GB); only where ``largest`` is given, those of more members get no path.
    """
    own, kind = parts.select("component", F.col("id").alias("src")), parts.schema["id"].dataType.simpleString()
    inner = edges.select("src", "dst").join(own, "src").join(parts.select(F.col("id").alias("dst"), F.col("component").alias("__to")), "dst").where("component = __to")
    # equal links and those to itself change no walk
    rows = inner.select("component", "src", "dst").union(own.withColumn("dst", F.lit(None).cast(kind)))
    dealt_out = rows.repartition("component").sortWithinPartitions("component", "src", F.asc_nulls_first("dst"))
    return dealt_out.mapInArrow(lambda batches: _walks(batches, largest), f"component {kind}, path array<{kind}>")


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """id, direction (out, in), neighbour of the given vertices (id)."""
    e = links(edges)
    outs = of.select("id").join(e.withColumnRenamed("src", "id"), "id").select("id", F.lit("out").alias("direction"), F.col("dst").alias("neighbour"))
    ins = of.select("id").join(e.withColumnRenamed("dst", "id"), "id").select("id", F.lit("in").alias("direction"), F.col("src").alias("neighbour"))
    return outs.union(ins)


def collapse_edges(files: DataFrame, edges: DataFrame, collapsed: DataFrame) -> DataFrame:
    """from_shown, to_shown, n_edges: each end becomes its shallowest collapsed ancestor (collapsed: dir), edges within one
    go. files: id, path."""
    up = files.select("id", F.posexplode(P.ancestors(F.col("path"))).alias("depth", "dir")).join(sized(keep(collapsed.select("dir").distinct()), width=F.octet_length("dir")), "dir")
    up = up.groupBy("id").agg(F.min_by("dir", "depth").alias("shown"))
    shown = keep(files.select("id", "path").join(up, "id", "left").select("id", F.coalesce("shown", "path").alias("shown")))
    e = edges.join(shown.selectExpr("id AS src", "shown AS a"), "src").join(shown.selectExpr("id AS dst", "shown AS b"), "dst")
    return e.where("a <> b").groupBy(F.col("a").alias("from_shown"), F.col("b").alias("to_shown")).agg(F.count("*").alias("n_edges"))


def rank_steps(ranked: DataFrame, edges: DataFrame, rank: str = "importance_rank") -> DataFrame:
    """id, rank, next_id and previous_id by rank, first_dependency and first_dependent by path. ranked: id, path and a
    rank without gaps, so neighbours join by it."""
    r = ranked.select("id", "path", rank)
    after, before = (r.select(F.col("id").alias(n), (F.col(rank) + d).alias(rank)) for n, d in (("next_id", -1), ("previous_id", 1)))
    e = links(edges)
    named = ranked.select(F.col("id").alias("other"), F.struct("path", "id").alias("named"))
    outs = e.withColumnRenamed("src", "id").withColumnRenamed("dst", "other").join(named, "other").groupBy("id").agg(F.min("named").getField("id").alias("first_dependency"))
    ins = e.withColumnRenamed("dst", "id").withColumnRenamed("src", "other").join(named, "other").groupBy("id").agg(F.min("named").getField("id").alias("first_dependent"))
    out = r.join(after, rank, "left").join(before, rank, "left").join(outs, "id", "left").join(ins, "id", "left")
    return out.select("id", rank, "next_id", "previous_id", "first_dependency", "first_dependent")


def condense(parts: DataFrame, edges: DataFrame, importance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components with their representative (the most important member, ties to the smaller id), and the edges between
    representatives. importance: id, importance."""
    w = Window.partitionBy("component").orderBy(F.desc("importance"), "id")
    reps = parts.join(importance, "id").withColumn("k", F.row_number().over(w)).where("k = 1").select("component", F.col("id").alias("representative"))
    of = keep(parts.join(reps, "component").select("id", "representative"))
    dag = links(edges).join(of.withColumnRenamed("id", "src").withColumnRenamed("representative", "a"), "src").join(of.withColumnRenamed("id", "dst").withColumnRenamed("representative", "b"), "dst")
    return of, keep(dag.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def bfs_layers(seeds: DataFrame, edges: DataFrame, deepest: int = C.ROADMAP_DEPTH) -> DataFrame:
    """id, layer: the shortest distance from any seed; deeper layers are pooled into ``deepest``."""
    frontier = keep(seeds.select("id").distinct().withColumn("layer", F.lit(0)))
    layers, depth = [frontier], 0
    e = keep(links(edges))
    while True:
        depth += 1
        step = e.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        seen = reduce(DataFrame.union, [x.select("id") for x in layers])
        frontier = keep(step.join(seen, "id", "left_anti").withColumn("layer", F.lit(min(depth, deepest))))
        if frontier.isEmpty():
            return reduce(DataFrame.union, layers)
        layers.append(frontier)
        if len(layers) > 30:  # so many files are read as one again
            layers = [keep(reduce(DataFrame.union, layers))]


def importance(files: DataFrame) -> DataFrame:
    """files (id, is_parsed, classification, page_rank, in_degree, line_count) with importance: a weighted sum of scaled rank,
    scaled in-degree and the class's weight, 0 for files that are not parsed. The scales are two global extremes."""
    ends = files.where("is_parsed").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("page_rank", "in_degree") for f in (F.min, F.max)))
    scaled = lambda c: F.coalesce((F.col(c) - F.col(f"min_{c}")) / F.nullif(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(0)), F.lit(0.0))
    boost = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in C.ROLE_BOOST.items() for x in kv)), F.col("classification")), F.lit(0.0))
    total = F.round(C.W_PAGERANK * scaled("page_rank") + C.W_IN_DEGREE * scaled("in_degree") + C.W_ROLE * boost, 6)
    out = files.crossJoin(F.broadcast(ends))  # one row
    return out.select(*files.columns, F.when(F.col("is_parsed"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).otherwise(F.lit(0.0)).alias("importance"))


def rank_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds 1-based ranks over all rows without sorting them in one task.

    Rows are range-partitioned and sorted; a rank is the row's place in its partition plus the rows of
    the partitions before, of which there is one number each.
    """
    part = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # an id holds its partition in the upper bits and the row's place in the lower 33
    where = F.shiftright("__at", 33)
    sizes = part.groupBy(where.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    out = part.withColumn("__p", where).join(F.broadcast(before), "__p")  # a row for each partition
    return out.withColumn(name, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).select(*df.columns, name)


def roadmap(files: DataFrame, entries: DataFrame, edges: DataFrame, graph: Dealt | None = None) -> DataFrame:
    """A reading order from entry points: order, id, section, n_companions, depends_on, in_degree, previous.

    files: id, path, classification, importance, in_degree; entries: id, rank. Seeds are the
    representatives of the first entries, or the most important one; layers of the condensed graph
    follow (core: 1 and 2, supporting: the rest), then leaf utilities and the most important of
    what is not reached. Everything after the layers is at most a few dozen rows. ``graph`` is the same graph
    as dealt() gives it.
    """
    if graph is None:
        with dealt(files, edges) as graph:
            return roadmap(files, entries, edges, graph)
    parts, short = components(graph)
    of, dag = condense(parts, short, files.select("id", "importance"))
    reps = keep(of.select(F.col("representative").alias("id")).distinct().join(files, "id"))
    seeds = entries.join(of, "id").groupBy("representative").agg(F.min("rank").alias("rank")).orderBy("rank").limit(C.ROADMAP_SEEDS).select(F.col("representative").alias("id"), "rank")
    seeds = keep(seeds)
    if seeds.isEmpty():
        seeds = keep(reps.orderBy(F.desc("importance"), "id").limit(1).select("id", F.lit(1).alias("rank")))
    layers = bfs_layers(seeds, dag)
    outs = dag.select(F.col("src").alias("id")).distinct().withColumn("has_out", F.lit(True))
    names = F.array(*(F.lit(s) for s in C.LEAF_SEGMENTS))
    placed = reps.join(layers, "id", "left").join(outs, "id", "left").join(seeds, "id", "left")
    leaf = (F.col("layer") >= 1) & F.col("has_out").isNull() & (F.col("classification").isin(C.LEAF_CLASSES) | F.arrays_overlap(F.split(F.lower("path"), "/"), names))
    placed = placed.withColumn("section", F.when(F.col("layer") == 0, "entry").when(leaf, "leaf-utility").when(F.col("layer").isNull(), "unreached").when(F.col("layer") <= 2, "core").otherwise("supporting"))
    some = placed.where("section = 'unreached'").orderBy(F.desc("importance"), "id").limit(C.ROADMAP_UNREACHED)
    entry = placed.where("section = 'entry'")
    n_entry = entry.count()  # at most ROADMAP_SEEDS
    rest = placed.where("section NOT IN ('entry', 'unreached')").union(some).orderBy(F.desc("importance"), "id").limit(min(max(C.ROADMAP_LENGTH, n_entry), C.ROADMAP_MAX) - n_entry)
    order = F.array_position(F.array(*(F.lit(s) for s in ("entry", "core", "supporting", "leaf-utility", "unreached"))), F.col("section"))
    depth = F.when(F.col("section").isin("core", "supporting"), F.col("layer")).otherwise(F.lit(0))
    degree = F.when(F.col("section").isin("core", "supporting"), -F.col("in_degree")).otherwise(F.lit(0))
    w = Window.orderBy(order, F.coalesce("rank", F.lit(0)), depth, F.desc("importance"), degree, "id")  # at most ROADMAP_MAX rows
    kept = keep(entry.union(rest).withColumn("order", F.row_number().over(w).cast("long")).withColumn("previous", F.lag("id").over(w)))
    sizes = of.groupBy(F.col("representative").alias("id")).agg((F.count("*") - 1).alias("n_companions"))
    out_links = links(edges.join(F.broadcast(kept.select(F.col("id").alias("src"))), "src")).groupBy(F.col("src").alias("id")).agg(F.slice(F.array_sort(F.collect_list("dst")), 1, C.ROADMAP_DEPENDS).alias("depends_on"))
    out = kept.join(sizes, "id").join(out_links, "id", "left")
    return out.select("order", "id", "section", "n_companions", F.coalesce("depends_on", F.array().cast("array<bigint>")).alias("depends_on"), "in_degree", "previous")
