"""Compression of vectors to codes of parts by integer codebooks.

Parts are sorted along a Hilbert curve and cut into flat blocks that store the least and greatest component in each dimension and
the sums. In each round, the distances from a block's box to the entries leave a short list; blocks with one entry
on it add their stored sums, the others are compared point by point with their lists only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.shared import join_hot, keep, sized
from quillstone.sources.tables import BROADCAST_ROWS

PARTS, ENTRIES, SCALE, BLOCK = 16, 64, 256, 256
#: Components whose multiples are greater than this are set to it; a distance beyond it doesn't fit into a long.
GREATEST = 1 << 40
#: Up to this size of components 64-bit integers hold all distances; beyond, Python's integers are used.
EXACT = 1 << 25
#: Numbers in the arrays that compare points with lists at once.
AT_ONCE = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers, floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(GREATEST))), F.lit(float(-GREATEST)))))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of coordinates below 2^bits) on a Hilbert curve; at most 63 bits in all.

    From the highest bit down, each coordinate's bit either exchanges low bits with the first
    coordinate or inverts the first one's; what results is a Gray code, whose bits are then interleaved.
    """
    x = points.T.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            up = (x[i] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    out = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | row >> bit & 1
    return out


def flat(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def in_parts(vectors: DataFrame, seeds: np.ndarray, parts: int) -> DataFrame:
    """A row for each part of each vector: part, place (on the curve), ref, vec_id, label (only of part 0), v."""
    width = seeds.shape[1] // parts
    used = min(width, 63)
    bits = max(1, min(10, 63 // used))
    low, high = seeds.min(axis=0), seeds.max(axis=0)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = flat(batch.column("q"), width * parts)
            grid = np.clip((q - low) * (1 << bits) // (high - low + 1), 0, (1 << bits) - 1)
            for part in range(parts):
                mine = slice(part * width, (part + 1) * width)
                rest = [batch.column(c) if part == 0 else pa.nulls(len(q), batch.column(c).type) for c in ("vec_id", "label")]
                place = hilbert(grid[:, mine][:, :used], bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), part), pa.int32()), pa.array(place), batch.column("ref"), *rest, listed(np.ascontiguousarray(q[:, mine]), pa.int64())], ["part", "place", "ref", "vec_id", "label", "v"])

    return vectors.select("ref", "vec_id", "label", "q").mapInArrow(run, f"part int, place long, ref long, vec_id {kinds['vec_id']}, label {kinds['label']}, v array<long>")


def blocks(parts: DataFrame, width: int, block: int) -> DataFrame:
    """Flat blocks of up to ``block`` neighbours on the curve: part, n, low, high, total, v (all components one after another), and
    ref, vec_id, label of each."""
    ordered = parts.repartitionByRange("part", "place", "ref").sortWithinPartitions("part", "place", "ref")
    kinds = {c: parts.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, v = batch.column("part").to_numpy(), flat(batch.column("v"), width)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            starts = np.concatenate([np.arange(a, b, block) for a, b in zip(first, [*first[1:], len(part)], strict=True)]) if len(part) else first
            if not len(starts):
                continue
            bounds = pa.array([*starts, len(part)], pa.int32())
            sums = np.add.reduceat(v, starts)  # GREATEST * block is far from 2^63
            columns = [pa.array(part[starts], pa.int32()), pa.array(np.diff([*starts, len(part)]), pa.int64())]
            columns += [listed(x, pa.int64()) for x in (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts), sums)]
            columns.append(pa.ListArray.from_arrays(pa.array(np.array([*starts, len(part)]) * width, pa.int32()), pa.array(v.reshape(-1))))
            columns += [pa.ListArray.from_arrays(bounds, batch.column(c)) for c in ("ref", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "low", "high", "total", "v", "ref", "vec_id", "label"])

    return ordered.mapInArrow(run, f"part int, n long, low array<long>, high array<long>, total array<long>, v array<long>, ref array<long>, vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>")


def short_lists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box the entries that can be nearest to a point in it: those no further from the box's nearest point than
    some entry is from its furthest one."""
    below, above = low[:, None, :] - entries, entries - high[:, None, :]
    near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    far = (np.maximum(-below, -above) ** 2).sum(axis=2)
    return near <= far.min(axis=1)[:, None]


def nearest(v: np.ndarray, n: np.ndarray, allowed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest entry of its block's list, ties to the lower one, and the squared distance. n: points of each
    block; blocks with lists of like length are compared together."""
    size = allowed.sum(axis=1)
    lists = np.argsort(~allowed, axis=1, kind="stable")  # the list's entries in order, then the others
    step = np.minimum(1 << np.ceil(np.log2(size)).astype(np.int64), allowed.shape[1])
    owner = np.repeat(np.arange(len(n)), n)
    index, distance = np.zeros(len(v), np.int64), np.zeros(len(v), v.dtype)
    for s in np.unique(step):
        points = np.flatnonzero(step[owner] == s)
        ahead = max(1, AT_ONCE // int(s * v.shape[1]))
        for k in range(0, len(points), ahead):
            some = points[k : k + ahead]
            list_ = lists[owner[some], :s]
            d = ((v[some, None, :] - entries[list_]) ** 2).sum(axis=2)
            least = d.min(axis=1)
            hit = np.where(d == least[:, None], list_, allowed.shape[1])  # what was added to a list may tie, but the list has the lowest
            index[some], distance[some] = hit.min(axis=1), least
    return index, distance


def by_part(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple]:
    """For each part in a batch of blocks: part, its blocks' n, low, high, total, its points, and its entries, in a type in
    which all distances are exact."""
    width = books.shape[2]
    part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
    low, high, total = (flat(batch.column(c), width) for c in ("low", "high", "total"))
    v = flat(batch.column("v"), width)
    upto = np.concatenate([[0], np.cumsum(n)])
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        points = K.ragged(upto[mine], n[mine])[0]
        arrays = [low[mine], high[mine], total[mine], v[points], books[p]]
        if max(np.abs(arrays[0]).max(initial=0), np.abs(arrays[1]).max(initial=0), max(abs(int(x)) for x in books[p].flat)) > EXACT:
            arrays = [x.astype(object) for x in arrays]
        else:
            arrays[-1] = arrays[-1].astype(np.int64)
        yield (int(p), n[mine], *arrays[:3], points, *arrays[3:])


def moved(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. Each task adds up its blocks; of each entry one sum per component and task is shuffled, and the
    driver gets one for each (parts x entries x width numbers, whatever the input's size)."""
    shared = stored.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        for batch in batches:
            for p, n, low, high, total, _, v, entries in by_part(batch, books):
                allowed = short_lists(low, high, entries)
                one = allowed.sum(axis=1) == 1
                entry = allowed.argmax(axis=1)
                np.add.at(counts[p], entry[one], n[one])
                np.add.at(sums[p], entry[one], total[one].astype(object))
                open_ = np.repeat(~one, n)
                index, _ = nearest(v[open_], n[~one], allowed[~one], entries)
                counts[p] += np.bincount(index, minlength=len(entries))
                for k in np.unique(index):
                    sums[p, k] += v[open_][index == k].sum(axis=0).astype(object)
        p, k = np.nonzero(counts)
        width = books.shape[2]
        at = np.tile(np.arange(width), len(p))
        columns = [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(k, width), pa.int32()), pa.array(at, pa.int32()), pa.array(np.repeat(counts[p, k], width)), pa.array([str(x) for x in sums[p, k].reshape(-1)], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "at", "n", "total"])

    each = stored.select("part", "n", "low", "high", "total", "v").mapInArrow(run, "part int, entry int, at int, n long, total string")
    new = books.copy()
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        new[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return new


def encoded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """ref, vec_id, label, code, error of each vector. Indexes are added up as bytes of as many longs as the parts need, so that
    one sum with few numbers brings a vector's parts together again."""
    shared = stored.sparkSession.sparkContext.broadcast(books)
    kinds = {c: stored.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            refs, ids, labels = (batch.column(c).flatten() for c in ("ref", "vec_id", "label"))
            for p, n, low, high, _, points, v, entries in by_part(batch, books):
                index, distance = nearest(v, n, short_lists(low, high, entries), entries)
                d = pa.array(distance) if distance.dtype == np.int64 else pa.array([int(x) if x < 1 << 63 else None for x in distance], pa.int64())
                at = pa.array(points)
                yield pa.RecordBatch.from_arrays([refs.take(at), ids.take(at), labels.take(at), pa.array(np.full(len(points), p), pa.int32()), pa.array(index), d], ["ref", "vec_id", "label", "part", "entry", "d"])

    each = stored.select("part", "n", "low", "high", "total", "v", "ref", "vec_id", "label").mapInArrow(run, f"ref long, vec_id {kinds['vec_id']}, label {kinds['label']}, part int, entry long, d long")
    words = range((len(books) + 7) // 8)
    byte = lambda w: F.sum(F.when(F.floor(F.col("part") / 8) == w, F.expr("shiftleft(entry, 8 * (7 - part % 8))")).otherwise(0))
    out = each.groupBy("ref").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), *(byte(w).alias(f"w{w}") for w in words), F.count("d").alias("n"), F.try_sum("d").alias("d"))
    code = F.lower(F.concat(*(F.lpad(F.hex(f"w{w}"), 16, "0") for w in words)))
    return out.select("ref", "vec_id", "label", F.substring(code, 1, 2 * len(books)).alias("code"), F.when(F.col("n") == len(books), F.col("d")).alias("error"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2, scale: int = SCALE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the codebooks (part, entry, component) as integers.

    The table has id_col, label_col, code (two hex digits for each part), error (squared distances from the
    entries, summed over parts) and label_error (error summed over equal labels, null labels together). Codebooks start from the ``entries`` smallest
    ids, ascending; equal ids ascend by their components, null ids come last. ``rounds`` times every entry becomes the
    floor of the mean of the parts nearest to it, ties to the lower entry; an entry without parts stays.

    Vectors that are null or have null or non-finite components are dropped, and so are those whose length isn't
    that of the vector with the smallest id; that length must be a positive multiple of ``parts``, or ValueError is raised. Repeated rows and ids
    count and are returned as often as they occur. With fewer vectors than ``entries``, codebooks are as short; an empty table gives
    an empty one. Components beyond 2^40 after scaling are set to it; an error too large for a long is null.

    Vectors are shuffled once, as parts by their place on the curve, ties by row, so that equal vectors may lie in any number of
    partitions; each block is read once in each round. At most 256 entries fit the two digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.monotonically_increasing_id().alias("ref"))
    named = named.where(usable(F.col("v"))).select("ref", "vec_id", "label", whole(F.col("v"), scale).alias("q"))
    smallest = lambda df, n: [r["q"] for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(n).collect()]
    first = smallest(named.where(F.size("q") > 0), entries)
    length = len(first[0]) if first else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    same = named.where(F.size("q") == length)
    if any(len(q) != length for q in first):
        first = smallest(same, entries)
    width = length // parts
    seeds = np.array(first, dtype=object).reshape(len(first), length)
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width).swapaxes(0, 1))
    bounds = seeds.astype(np.int64) if len(first) else np.zeros((1, length), np.int64)
    stored = keep(blocks(in_parts(same, bounds, parts), width, block))
    for _ in range(rounds):
        books = moved(stored, books)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    codes = keep(encoded(stored, books).withColumn("key", key))
    totals = keep(codes.groupBy("key").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"), F.count("*").alias("n")))
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = codes.join(sized(totals.drop("n"), width=F.octet_length("key") + 16), "key")
    else:
        out = join_hot(codes, totals, "key", "n")
    return out.select(F.col("vec_id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def flattened(books: np.ndarray) -> str:
    """All components by part, entry and place, as decimal integers parted by commas."""
    return ",".join(str(int(x)) for x in books.reshape(-1))
