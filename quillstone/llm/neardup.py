"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.shared import components, fingerprint, join_hot, keep, sized, without

#: Places of the permutations.
CIRCLE = 1 << 20
#: At a similarity of 0.8, (1 - 0.8 ** 5) ** 30 = 7 of a million pairs share no band.
BANDS, ROWS = 30, 5
#: Bits of a set's mask; larger sets than about as many shingles are compared without its help.
MASK_BITS = 2048
#: Members of a bucket that one task compares with one another, or with as many others, at once.
BLOCK = 512
#: Shingles whose signature windows are held in memory at once.
AT_ONCE = 4096


class Circulant:
    """Signatures from two permutations: the first scatters shingles over the circle; coordinate k is the least value
    of the second permutation, shifted by k, over the scattered places. All coordinates of a shingle are then one
    contiguous window of the second permutation."""

    def __init__(self, size: int, seed: int = 20):
        pi = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: size - 1]]), size)
        self.size = size

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        place = (K.mix(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(44)).astype(np.int64)
        out = np.full(self.size, np.iinfo(np.uint32).max, dtype=np.uint32)
        for i in range(0, len(place), AT_ONCE):
            np.minimum(out, self.windows[place[i : i + AT_ONCE]].min(axis=0), out=out)
        return out

    def bands(self, shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
        keys = self.signature(shingles).reshape(bands, rows).astype(np.uint64)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            out = K.mix(out * np.uint64(31) + keys[:, j] + np.uint64(j))
        return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its different k-word shingles; of a shorter text, of its whole word sequence."""
    low = K.lower_ascii(raw)
    starts, ends, first = K.spans(low, offsets, K.SPACE)
    words = K.span_hashes(low, starts, ends)
    whole = K.sequences(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        else:
            yield K.sequences(words[a:b], b - a) if b > a else words[:0]


def _sign(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, fp, n_shingles, s1 and s2 (128 bits that identify the set), bands of docs (id, fp, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circulant(bands * rows)
        for batch in batches:
            for first, last, raw, offsets in K.blocks(batch.column(2)):
                n, s1, s2, keys = [], [], [], []
                for x in shingle_sets(raw, offsets, k):
                    n.append(len(x))
                    s1.append(int(K.mix(x + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(K.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(K.as_long(circle.bands(x, bands, rows)) if len(x) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "fp", "n_shingles", "s1", "s2", "bands"])

    return docs.select("id", "fp", "text").mapInArrow(sign, "id long, fp long, n_shingles long, s1 long, s2 long, bands array<long>")


def mask(shingles: np.ndarray) -> bytes:
    """A bit of MASK_BITS for each shingle, several may share one."""
    bits = np.zeros(MASK_BITS, dtype=np.uint8)
    bits[(shingles & np.uint64(MASK_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in K.blocks(batch.column(1)):
                found = list(shingle_sets(raw, offsets, k))
                masks = [mask(x) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([K.as_long(x) for x in found], pa.list_(pa.int64())), pa.array(masks, pa.binary())], ["node", "shingles", "mask"])

    return docs.mapInArrow(sets, "node long, shingles array<long>, mask binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, copies) those with 100 * |A and B| >= percent * |A or B|, on full sets, as (a, b).

    A set a that many pairs have comes in so many copies, among which its pairs are dealt by b, so that no task gets
    all pairs of one set; copies is about the number of pairs by BLOCK.
    """
    wanted = pairs.select("a", "copies").distinct().join(sets.selectExpr("node AS a", "shingles AS sa"), "a")
    wanted = wanted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    both = pairs.join(sets.selectExpr("node AS b", "shingles AS sb"), "b").withColumn("copy", F.pmod(F.xxhash64("b"), "copies")).join(wanted, ["a", "copies", "copy"])
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, node, n, label) of the groups in which labels differ, with total, big and n_big: the group's size, its
    commonest label and how many have it."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key")
    sizes = keep(sizes.agg(F.sum("m").alias("total"), F.max_by("label", F.struct("m", "label")).alias("big"), F.max("m").alias("n_big")).where("n_big < total"))
    return join_hot(members, sizes, "key", "total")


def _by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (node, n, label), grouped anew by the shingles of their prefixes.

    Sets that are alike share so many shingles that, in any common order, one lies among the first
    n - ceil(n * percent / 100) + 1 of each. Ordered by rarity those are shingles that few members have, so
    the groups are small but for members whose shingles are all common.
    """
    each = keep(members.join(sets.select("node", "shingles"), "node").select("node", "n", "label", F.explode("shingles").alias("h")))
    df = keep(each.groupBy("h").agg(F.count("*").alias("df")))
    ordered = join_hot(each, df, "h", "df").groupBy("node", "n", "label").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))  # one set's shingles
    first = F.expr(f"slice(all, 1, cast(n - ceil(n * {percent} / 100D) + 1 AS int))")
    return ordered.select(F.explode(first).alias("x"), "node", "n", "label").select(F.col("x.h").alias("key"), "node", "n", "label")


def _possible_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within a bucket of members (key, node, n, label) that have different labels and may be alike.

    Buckets of more than BLOCK members are grouped anew by their members' rarest shingles. A bit that
    only one mask has stands for a shingle that only that set has, so such bits bound what two sets
    share: no similar pair fails the bound. Groups are dealt in blocks of about BLOCK members, those with the
    group's commonest label apart, since they need not be compared with one another; a task
    compares two blocks at a time, however large the group is, and only possible pairs come out.
    """
    mixed = keep(_mixed(members))
    few = mixed.where(F.col("total") <= BLOCK)
    many = mixed.where(F.col("total") > BLOCK).select("node", "n", "label").distinct()
    if not many.isEmpty():
        few = few.unionByName(_mixed(keep(_by_prefix(keep(many), sets, percent))))
    big, rest = (F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int") for c in (F.col("n_big"), F.col("total") - F.col("n_big")))
    one, is_big = F.col("total") <= BLOCK, F.col("label") == F.col("big")
    own = F.when(one, 0).when(is_big, F.pmod(F.xxhash64("node"), big)).otherwise(big + F.pmod(F.xxhash64("node"), rest)).cast("int")
    others = F.when(one, F.array(F.lit(0))).when(is_big, F.sequence(big, big + rest - 1)).otherwise(F.sequence(F.lit(0), big + rest - 1))
    dealt = few.withColumn("own", own).withColumn("other", F.explode(others)).join(sets.select("node", "mask"), "node")
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "label", "mask")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def alike(own: np.ndarray, node: np.ndarray, n: np.ndarray, label: np.ndarray, masks: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(masks, axis=1).astype(np.float32)
        common, count = bits @ bits.T, bits.sum(axis=1)
        left = n - count
        most = common + np.minimum(left[:, None], left[None, :])
        ok = (100 + percent) * most >= percent * (n[:, None] + n[None, :])
        ok &= (label[:, None] != label[None, :]) & (node[:, None] < node[None, :])
        if across:
            ok &= own[:, None] != own[None, :]
        i, j = np.nonzero(ok)
        return node[i], node[j]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(part: pa.Table) -> Iterator[pa.RecordBatch]:
            where = [part.column(c).to_numpy() for c in ("key", "low", "high")]
            cut = np.flatnonzero(np.any([np.diff(x, prepend=x[0] - 1) != 0 for x in where], axis=0))
            own, node, n, label = (part.column(c).to_numpy() for c in ("own", "node", "n", "label"))
            masks = np.frombuffer(b"".join(part.column("mask").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), part.num_rows], strict=True):
                if y - x > 1 and (label[x:y] != label[x]).any():
                    i, j = alike(own[x:y], node[x:y], n[x:y].astype(np.float32), label[x:y], masks[x:y], where[1][x] != where[2][x])
                    a.append(i), b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:  # the last group of a batch may go on in the next one
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            last = [now.column(c).to_numpy() for c in ("key", "low", "high")]
            before = np.flatnonzero(np.any([x != x[-1] for x in last], axis=0))
            begin = int(before[-1]) + 1 if len(before) else 0
            if begin:
                yield from groups(now.slice(0, begin).combine_chunks())
            rest = now.slice(begin).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from groups(rest)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels (node, component) that connect, within each bucket of members (key, node, n, c), all that are similar.

    First every member is compared with one pivot of its bucket, the one that shares the most
    buckets, hence nearest to a common original: this joins tight groups of any size with a row for each member, and
    copies of the pivot's set meet so many members each. In
    buckets that then hold more than one component, _possible_pairs() finds the members of different
    components that may be alike, and those are compared on full sets. So no possible pair is left
    out, and the pairs of a tight group are not formed.
    """
    order = F.struct((-F.col("c")).alias("c"), F.xxhash64("node").alias("x"), F.col("node"))
    pivot = keep(members.groupBy("key").agg(F.min_by(F.struct("node", "n"), order).alias("p"), F.count("*").alias("size")))
    met = join_hot(members, pivot, "key", "size").where(f"node <> p.node AND 100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    met = met.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.max(F.ceil(F.col("size") / BLOCK)).alias("copies"))
    links = keep(_verified(keep(met), sets, percent))
    labels = keep(components(links))
    here = keep(members.join(labels, "node", "left").selectExpr("key", "node", "n", "coalesce(component, node) AS label"))
    pairs = keep(_possible_pairs(here, sets, percent))
    often = keep(pairs.groupBy("a").agg(F.count("*").alias("times")).withColumn("copies", F.ceil(F.col("times") / BLOCK)))
    more = keep(_verified(join_hot(pairs, often, "a", "times"), sets, percent))
    if not more.isEmpty():
        labels = keep(components(links.union(more)))
    return labels


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of all docs: id_col, fp (xxhash64 of the text), n_shingles, component_id, component_fp, kept;
    one row for each row of docs.

    Words are what white space parts, A-Z lower-cased; a text's set are its different shingles of
    ``shingle_words`` words (a shorter text: its whole word sequence). Texts with 100 * common >=
    percent * union are linked, confirmed on full sets; component_id is the smallest id reachable,
    component_fp the fp of its text (the least, if rows of that id have several), kept is true for that id. Texts
    without words, and null texts, are linked with nothing. Texts with the same set are one class, so
    copies are never paired. A row with a repeated id has the component of its own text; two texts
    of one id don't link each other's copies. Null ids are linked with nothing (component_id null, kept
    true). Other columns of docs are not read. Ids are integers.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), fingerprint(text_col).alias("fp"), F.col(text_col).alias("text"))
    signed = keep(_sign(named, shingle_words, bands, rows))
    real = signed.where("n_shingles > 0 AND id IS NOT NULL")
    classes = real.groupBy("s1", "s2").agg(F.min(F.struct("id", "fp")).alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select(F.explode("bands").alias("key"), "node", "n")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = keep(keyed.join(shared, "key", "left_semi"))
    wanted = keep(members.select("node").distinct().join(classes.select("node", "low.id", "low.fp"), "node"))
    sets = keep(_sets(named.join(sized(wanted), ["id", "fp"]).select("node", "text"), shingle_words).dropDuplicates(["node"]))
    members = keep(members.join(members.groupBy("node").agg(F.count("*").alias("c")), "node"))
    linked = _links(members, sets, percent).join(classes.select("node", "low"), "node")
    first = linked.groupBy("component").agg(F.min("low").alias("first"))
    grouped = classes.select("s1", "s2", "node", "low").join(linked.select("node", "component"), "node", "left").join(first, "component", "left").select("s1", "s2", F.coalesce("first", "low").alias("first"))
    out = signed.drop("bands").join(grouped, ["s1", "s2"], "left")
    real_row = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    out = out.withColumn("component_id", F.when(real_row, F.col("first.id")).otherwise(F.col("id"))).withColumn("component_fp", F.when(real_row, F.col("first.fp")).otherwise(F.col("fp")))
    return out.select(F.col("id").alias(id_col), "fp", "n_shingles", "component_id", "component_fp", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group that near_duplicates() found (kept): the one with the smallest id, of rows that share
    it the one with the least fp, of equal rows the least in all columns. Rows without words or id all stay."""
    linked = found.where("n_shingles > 0").where(F.col(id_col).isNotNull())
    chosen = (F.col(id_col) == F.col("component_id")) & (F.col("fp") == F.col("component_fp"))
    again = keep(linked.where(chosen).groupBy(id_col, "fp").agg(F.count("*").alias("n")).where("n > 1").select(id_col, "fp"))
    if again.isEmpty():
        return without(docs, linked.where(~chosen), id_col, text_col)
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    row = docs.select(F.struct(F.col(id_col).alias("id"), fingerprint(text_col).alias("fp")).alias("key"), every.alias("row"))
    repeated = row.join(sized(again.select(F.struct(F.col(id_col).alias("id"), "fp").alias("key"))), "key").groupBy("key").agg(F.min("row").alias("row")).select("row.*")
    return without(docs, linked.where(~chosen).select(id_col, "fp").union(again), id_col, text_col).unionByName(repeated)
