"""Line de-duplication: shared rare line hashes find overlapping documents, a patience diff aligns them, and aligned blocks
go from the later one."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.shared import join_hot, keep


def _runs(docs: DataFrame, least_words: int) -> DataFrame:
    """id, fp, words (number by line), h, at, to: hash, first line and line after the last of each run of lines that is the
    shortest of ``least_words`` words from its first line on, or up to its last line."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, last_row, raw, offsets in K.blocks(batch.column(2)):
                low = K.lower_ascii(raw)
                starts, ends, first = K.spans(low, offsets, K.SPACE)
                breaks = np.flatnonzero(raw == 0x0A)
                line = np.searchsorted(breaks, starts) + K.owners(first)
                n_lines = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
                cuts = np.concatenate([[0], np.cumsum(n_lines)])
                words = np.bincount(line, minlength=int(n_lines.sum()))
                full = np.flatnonzero(words)  # lines with words, over all texts of the block
                by_line = words[full]
                _, place = K.ragged(np.zeros(len(full), np.int64), by_line)
                sums = K.mix(K.sums(K.mix(K.span_hashes(low, starts, ends) + K.mix(place.astype(np.uint64))), by_line))
                lines = np.arange(len(words))
                low_end, high_end = np.repeat(cuts[:-1], n_lines), np.repeat(cuts[1:], n_lines)  # of each line's text
                upto = np.concatenate([[0], np.cumsum(by_line)])
                # for each line the next one with words, from which the shortest run goes on, and the last one, at which it ends
                next_, last = np.searchsorted(full, lines, "left"), np.searchsorted(full, lines, "right") - 1
                to = np.searchsorted(upto, upto[:-1] + least_words, "left")
                at = np.searchsorted(upto, upto[1:] - least_words, "right") - 1
                stops, starts_ = np.append(full, len(words))[np.append(to, 0) - 1] + 1, np.append(full, -1)[np.append(at, -1)]
                whole = (next_ < len(full)) & (np.append(to, len(full) + 1)[next_] <= len(full))
                whole[whole] &= stops[next_[whole]] <= high_end[whole]
                ending = (last >= 0) & (np.append(at, -1)[last] >= 0)
                ending[ending] &= starts_[last[ending]] >= low_end[ending]
                i, j = next_[whole], last[ending]
                begin, end = np.concatenate([i, at[j]]), np.concatenate([to[i], j + 1])  # lines with words
                beside = np.concatenate([full[i] - lines[whole], (lines[ending] - full[j]) << 32])  # lines without, before or after
                start, stop = np.concatenate([lines[whole], starts_[j]]), np.concatenate([stops[i], lines[ending] + 1])
                _, once = np.unique(start * (len(words) + 1) + stop, return_index=True)
                begin, end, beside, start, stop = (x[once] for x in (begin, end, beside, start, stop))
                which, place = K.ragged(begin, end - begin)
                gap = np.where(place > 0, full[which] - full[which - 1], 0)  # lines without words count by their number
                h = K.mix(K.sums(K.mix(sums[which] + K.mix((place << 32 | gap).astype(np.uint64))), end - begin) + K.mix((beside * 2 + 1).astype(np.uint64)))
                back = cuts[np.searchsorted(cuts, start, "right") - 1]
                by_text, by_run = pa.array(cuts, pa.int32()), pa.array(np.searchsorted(start, cuts), pa.int32())
                m = last_row - first_row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first_row, m), batch.column(1).slice(first_row, m), pa.ListArray.from_arrays(by_text, pa.array(words, pa.int32()))] + [pa.ListArray.from_arrays(by_run, x) for x in (pa.array(K.as_long(h)), pa.array(start - back, pa.int32()), pa.array(stop - back, pa.int32()))],
                    ["id", "fp", "words", "h", "at", "to"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "fp", "text").mapInArrow(cut, f"id {kind}, fp long, words array<int>, h array<long>, at array<int>, to array<int>")


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """The longest series of pairs (place here, place there) that rises on both sides, by piles: indices into pairs, which
    are ordered by the first place and have each place once on each side."""
    tops: list[int] = []  # the least last place of a series of each length
    ends: list[int] = []
    back: list[int] = []
    for i, (_, there) in enumerate(pairs):
        p = bisect.bisect_left(tops, there)
        back.append(ends[p - 1] if p else -1)
        tops[p : p + 1] = [there]
        ends[p : p + 1] = [i]
    at, out = (ends[-1] if ends else -1), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(runs: list[tuple[int, int, int]], gone: bytearray, rounds: int = 3) -> list[tuple[int, int, int]]:
    """Common blocks (first line here, line after the last, first line there) of a document and one partner.

    runs: at, to, there of each shared run, by ``at``; gone marks the document's lines that are
    matched already. As in a patience diff, the runs that occur once on both sides are anchors, the
    longest series of them that rises on both sides is matched, and neighbours that touch without a
    shift form a block. What is left (in another order, or recurring) is aligned again; after
    so many rounds each run left is matched by itself, so the work stays proportional.
    """
    blocks: list[tuple[int, int, int]] = []
    left = runs
    for i in range(rounds + 1):
        left = [r for r in left if gone.find(0, r[0], r[1]) >= 0]
        times = Counter(there for _, _, there in left)
        once = [r for r in left if times[r[2]] == 1] if i < rounds else []
        chain = [once[k] for k in patience([(r[0], r[2]) for r in once])] or left
        begin = len(blocks)
        for at, to, there in chain:
            gone[at:to] = b"\1" * (to - at)
            if len(blocks) > begin and at <= blocks[-1][1] and blocks[-1][2] - blocks[-1][0] == there - at:
                blocks[-1] = (blocks[-1][0], to, blocks[-1][2])
            else:
                blocks.append((at, to, there))
    return blocks


def covered(words: pa.Array, at: np.ndarray, to: np.ndarray, n_blocks: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each text the lines (from 0) that lie in one of its blocks, and the words of these lines."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(n)])
    by_line = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.repeat(cuts[:-1], n_blocks)
    inside = np.cumsum(np.bincount(at + base, minlength=cuts[-1] + 1) - np.bincount(to + base, minlength=cuts[-1] + 1))[:-1] > 0
    lines = np.flatnonzero(inside)
    upto = np.concatenate([[0], np.cumsum(np.where(inside, by_line, 0))])
    removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(lines, cuts), pa.int32()), pa.array(lines - np.repeat(cuts[:-1], n)[lines], pa.int32()))
    return removed, pa.array(upto[cuts[1:]] - upto[cuts[:-1]], pa.int64())


def line_overlaps(docs: DataFrame, least_block_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to delete from each document because an earlier one (with a smaller id) has them in the same order.

    Returns id_col, fp (xxhash64 of the text), n_lines, removed (line numbers from 0), n_removed_words,
    blocks (at, to, partner, partner_at: what was aligned with which document); one row for each
    different (id, text). Lines are parted by \\n and compared by their words, A-Z lower-cased.

    The hashes by which documents meet are those of runs of lines: the shortest runs of
    ``least_block_words`` words from each line on, and up to each line; single lines, where they are
    long enough. Every line of a common block of so many words lies in such a run. Each shared run
    pairs a document with one partner, the first document that has it, so nothing grows faster than
    the lines and no frequency is too high. Partners are aligned by the rarity of their rarest
    shared run, rare ones first, by patience diff (see align()); a partner aligned later gets the
    runs that no earlier one explains. So every block of consecutive lines of
    ``least_block_words`` words that an earlier document has too goes, however often it
    occurs within or among documents. That first document keeps it. Null texts are empty; lines without words go only
    within a block; a repeated row has one result; a repeated id with other texts is ordered
    by fp; rows without id are never paired.
    """
    if least_block_words < 1:
        raise ValueError("least_block_words must be 1 at least")
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), F.col(text_col).alias("text"))
    texts = keep(_runs(named, least_block_words).dropDuplicates(["id", "fp"]))
    each = texts.where("id IS NOT NULL").select("id", "fp", F.expr("inline(arrays_zip(h, at, to))"))
    here = F.struct("id", "fp")
    shared = each.groupBy("h").agg(F.min(F.struct("id", "fp", "at")).alias("first"), F.max(here).alias("last"), F.count("*").alias("df"))
    shared = keep(shared.where("struct(first.id, first.fp) < last").select("h", "first", "df"))
    met = join_hot(each, shared, "h", "df").where("struct(id, fp) > struct(first.id, first.fp)")
    runs = met.groupBy("id", "fp").agg(F.collect_list(F.struct(F.col("first.id").alias("partner"), F.col("first.fp").alias("partner_fp"), "at", "to", F.col("first.at").alias("there"), "df")).alias("runs"))
    both = texts.select("id", "fp", "words").join(runs, ["id", "fp"], "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block_type = pa.struct([("at", pa.int32()), ("to", pa.int32()), ("partner", batch.column(0).type), ("partner_at", pa.int32())])
            found: list[list] = []
            for n, runs in zip(pc.list_value_length(batch.column(2)).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = bytearray(n if runs else 0)
                by_partner: dict[tuple, list] = {}
                for r in runs or ():
                    by_partner.setdefault((r["partner"], r["partner_fp"]), []).append((r["at"], r["to"], r["there"], r["df"]))
                mine: list = []
                for (partner, _), some in sorted(by_partner.items(), key=lambda x: (min(r[3] for r in x[1]), x[0])):
                    mine += [{"at": at, "to": to, "partner": partner, "partner_at": there} for at, to, there in align([r[:3] for r in sorted(some)], gone)]
                found.append(mine)
            flat = [b for mine in found for b in mine]
            at, to = (np.fromiter((b[k] for b in flat), np.int64, len(flat)) for k in ("at", "to"))
            removed, n_words = covered(batch.column(2), at, to, np.fromiter(map(len, found), np.int64, len(found)))
            n_lines = pc.list_value_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_lines, removed, n_words, pa.array(found, pa.list_(block_type))], ["id", "fp", "n_lines", "removed", "n_removed_words", "blocks"])

    return keep(both.mapInArrow(mark, f"id {kind}, fp long, n_lines long, removed array<int>, n_removed_words long, blocks array<struct<at:int,to:int,partner:{kind},partner_at:int>>")).withColumnRenamed("id", id_col)


def remove_lines(docs: DataFrame, overlaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines named by line_overlaps() taken out of text_col; all rows and all other columns stay. A text
    that loses no line is unchanged; one that loses all is empty."""
    free = lambda name: next(n for n in (name + "_" * i for i in range(1, 99)) if n not in docs.columns)
    at, which, removed = free("__id"), free("__fp"), free("__removed")
    marks = overlaps.where("size(removed) > 0").select(F.col(id_col).alias(at), F.col("fp").alias(which), F.col("removed").alias(removed))
    joined = docs.join(marks, docs[id_col].eqNullSafe(marks[at]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == marks[which]), "left")
    # The lines are bound to l, so that the text is split once; array_except looks numbers up by hash.
    left = F.expr(f"transform(array(split(`{text_col}`, '\\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), `{removed}`), i -> l[i]), '\\n'))[0]")
    return joined.withColumn(text_col, F.when(F.col(removed).isNotNull(), left).otherwise(F.col(text_col))).select(*docs.columns)
