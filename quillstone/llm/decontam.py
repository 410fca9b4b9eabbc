"""Benchmark decontamination: a prefix-filtered join of word shingles with exact containment of item windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.shared import fingerprint, is_small, join_hot, keep, sized

#: Least and greatest number of a hash's bits by which a task tells shingles that no item has from those that one may have:
#: filters of 2 to 128 MB, sized by the items.
FILTER_BITS = 24, 30
#: Occurrences of a prefix token that a task gets at once, where its windows are too many to be broadcast.
OCCURRENCES = 1 << 16


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = K.lower_ascii(raw)
    starts, ends, first = K.spans(low, offsets, K.NOT_ALNUM)
    return low.tobytes(), starts, ends, first, K.span_hashes(low, starts, ends)


def item_windows(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Every window of every item: item_id, words, shingles (offset, words, hash)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, raw, offsets in K.blocks(batch.column(1)):
                data, starts, ends, first, hashes = _words(raw, offsets)
                which, words, shingles = [], [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    n = min(window, b - a)
                    k = min(shingle, n)
                    for j in range(a, b - n + 1 if n else a):
                        which.append(first_row + i)
                        words.append([data[starts[w] : ends[w]].decode() for w in range(j, j + n)])
                        shingles.append([{"off": o, "k": k, "h": h} for o, h in enumerate(K.as_long(K.sequences(hashes[j : j + n], k)).tolist())])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(words, pa.list_(pa.string())), pa.array(shingles, pa.list_(pa.struct([("off", pa.int32()), ("k", pa.int32()), ("h", pa.int64())])))], ["item_id", "words", "shingles"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(id_col, text_col).mapInArrow(cut, f"item_id {kind}, words array<string>, shingles array<struct<off:int,k:int,h:long>>").dropDuplicates(["item_id", "words"])


def filter_bits(n_shingles: int) -> int:
    """Bits of the filter: sixteen places or more for each shingle, as far as the greatest filter has them."""
    return min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * n_shingles - 1).bit_length()))


def shared_runs(docs: DataFrame, bits: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """For each row of docs its words in number, and the runs of words whose shingles may be an item's.

    The filter lets some other shingles through and never drops one; the join decides.
    """
    bits_shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_shared.value
        drop = np.uint64(61 - len(bits).bit_length() + 1)  # len(bits) is a power of two
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())])))]))
        for batch in batches:
            for first_row, last_row, raw, offsets in K.blocks(batch.column(2)):
                data, starts, ends, first, hashes = _words(raw, offsets)
                own_end = np.repeat(first[1:], np.diff(first))
                at, size, found = [], [], []
                for k in sizes:
                    h = K.sequences(hashes, k)
                    place = h >> drop
                    hit = np.flatnonzero((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                    hit = hit[hit + k <= own_end[hit]]
                    at.append(hit), size.append(np.full(len(hit), k)), found.append(K.as_long(h[hit]))
                runs: list[list | None] = [None] * (last_row - first_row)
                at, size, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, size, found))
                order = np.lexsort((size, at))
                at, size, found = at[order], size[order], found[order]
                owner = np.searchsorted(first, at, "right") - 1
                reach = 0
                for w, k, h, i in zip(at.tolist(), size.tolist(), found.tolist(), owner.tolist(), strict=True):
                    if runs[i] is None:
                        runs[i], reach = [], -1
                    if w > reach:
                        runs[i].append({"start": w - int(first[i]), "words": [], "hits": []})
                        reach = w
                    run = runs[i][-1]
                    run["words"] += [data[starts[x] : ends[x]].decode() for x in range(reach, w + k)]
                    reach = max(reach, w + k)
                    run["hits"].append({"at": w - int(first[i]) - run["start"], "h": h})
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first_row, last_row - first_row) for k in (0, 1)), pa.array(np.diff(first)), pa.array(runs, run_type)], ["id", "fp", "n_words", "runs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, fingerprint(text_col).alias("fp"), text_col).mapInArrow(find, f"id {kind}, fp long, n_words long, runs array<struct<start:long,words:array<string>,hits:array<struct<at:int,h:long>>>>").withColumn("row", F.monotonically_increasing_id())


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which words of each document lie in an occurrence of a window of an item: id_col, fp (xxhash64 of the text), n_words,
    n_hit, n_items, items (sorted ids as strings), contaminated; one row for each row of docs.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. A window is ``window``
    consecutive words of an item, or all words of a shorter one. Every window has one necessary
    prefix token, its rarest shingle over all documents (exact containment leaves a prefix of one);
    windows with a shingle that no document has are dropped at once. Occurrences of prefix tokens
    give candidates at one position each, which must lie within a run of shared shingles and are
    then compared word by word. A window that many items share is matched once, and its items are
    added to each document once. Null and empty texts have no words and no hits; an empty table of
    items or documents gives no hits or no rows; repeated rows and ids are judged each by itself;
    null item ids hit but are not listed; other columns are not read.
    """
    windows = keep(item_windows(items, window, shingle, item_col, item_text_col))
    classes = keep(windows.groupBy("words").agg(F.first("shingles").alias("shingles")).withColumn("window", F.monotonically_increasing_id()))
    tokens = classes.select(F.explode("shingles").alias("s"))
    sizes = sorted(r["k"] for r in tokens.select("s.k").distinct().collect())  # at most `shingle`
    n_bits = filter_bits(tokens.select("s.h").distinct().count())
    runs = keep(shared_runs(docs, _bits(tokens.select("s.h"), n_bits), sizes, id_col, text_col))

    found = runs.where("runs IS NOT NULL").select("row", F.explode("runs").alias("run"))
    near = window - 1
    local = found.select("row", "run.start", "run.words", F.explode("run.hits").alias("hit")).selectExpr("row", "start", "hit.at AS at", "hit.h AS h", f"greatest(hit.at - {near}, 0) AS low", f"slice(words, greatest(hit.at - {near}, 0) + 1, {2 * window}) AS around")
    frequency = found.select("row", F.explode(F.array_distinct("run.hits.h")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    each = classes.select("window", "words", F.explode("shingles").alias("s")).select("window", "words", "s.off", "s.h")
    prefix = each.join(frequency, "h", "left").groupBy("window").agg(F.first("words").alias("words"), F.min_by(F.struct("off", "h"), F.struct(F.coalesce("df", F.lit(0)), "h", "off")).alias("p"), F.min(F.coalesce("df", F.lit(0))).alias("least")).where("least > 0")
    prefix = keep(prefix.select("window", "words", "p.off", "p.h", F.col("least").alias("df")))
    if is_small(prefix, width=F.octet_length(F.array_join("words", " "))):
        met = local.join(F.broadcast(prefix.drop("df")), "h")
    else:  # a frequent token's occurrences are dealt over copies of its windows
        copies = prefix.withColumn("copies", F.ceil(F.col("df") / OCCURRENCES))
        often = keep(copies.select("h", "copies", "df").distinct())
        dealt = join_hot(local, often, "h", "df").withColumn("copy", F.pmod(F.xxhash64("row", "start", "at"), "copies"))
        met = dealt.drop("df", "copies").join(copies.drop("df").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))), ["h", "copy"])
    met = met.withColumn("from", F.expr("at - off - low")).where("`from` >= 0 AND `from` + size(words) <= size(around)").where(F.expr("slice(around, `from` + 1, size(words)) = words"))
    met = keep(met.selectExpr("row", "start + at - off AS low", "start + at - off + size(words) AS high", "window"))

    before = F.max("high").over(Window.partitionBy("row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    hits = met.select("row", "low", "high").distinct().withColumn("before", F.coalesce(before, F.lit(0))).groupBy("row").agg(F.sum(F.expr("greatest(0, high - greatest(low, before))")).alias("n_hit"))
    holders = keep(windows.join(classes.select("words", "window"), "words").select("window", F.col("item_id").cast("string").alias("item_id")))
    listed = met.select("row", "window").distinct().join(sized(holders, width=F.octet_length("item_id") + 8), "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = runs.drop("runs").join(hits, "row", "left").join(listed, "row", "left")
    return out.select(F.col("id").alias(id_col), "fp", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _bits(tokens: DataFrame, n_bits: int) -> np.ndarray:
    """One bit for each value of the first n_bits bits of a hash h. The bits are set in Spark: at most 2 ** n_bits / 32,768
    rows of 4 KB each come to the driver."""
    place: Column = F.shiftrightunsigned("h", 64 - n_bits)
    parts = tokens.select(F.bitmap_bucket_number(place + 1).alias("bucket"), F.bitmap_bit_position(place + 1).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (n_bits - 3), dtype=np.uint8)
    for row in parts.collect():  # bucket 1 has the places from 0 on
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out
