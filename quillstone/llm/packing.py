"""Packing of tokenised texts into windows by length combinations solved against the histogram."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.tokens import encoder, share_tokenizer

#: Gaps of fewer tokens are padded; larger ones are filled by cutting a tail.
LEAST_CUT = 8
#: Tokens of tails that a task plans at once, and pieces that it hands over at once.
CHUNK_TOKENS, BATCH_PIECES = 1 << 21, 1024


def combinations(window: int, histogram: np.ndarray, shallow: int = 8) -> np.ndarray:
    """Combinations of up to three lengths that fill the window exactly, as rows of three lengths (0: none).

    A single length that is a power of two fills a sequence of its own. Of the triples with a given
    shortest length, those ``shallow`` are taken whose rarest member is most frequent; this bounds
    the solver's columns only: lengths in no column are packed by the greedy step.
    """
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    one = lengths[(lengths & (lengths - 1)) == 0]
    low = lengths[2 * lengths <= window]
    pair = low[histogram[window - low] > 0]
    rows = [np.stack([one, one * 0, one * 0], axis=1), np.stack([window - pair, pair, pair * 0], axis=1)]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (a + 2 * lengths <= window)]
        rarest = np.minimum(histogram[b], histogram[window - a - b])
        b = b[np.argsort(-rarest, kind="stable")[:shallow]]
        b = b[histogram[window - a - b] > 0]
        rows.append(np.stack([window - a - b, b, np.full_like(b, a)], axis=1))
    return np.concatenate(rows)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x of the combinations with sum(x * combination) near the histogram.

    Projected gradient steps with momentum; the work depends on the window only.
    """
    target = histogram.astype(float)
    target[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, j], x, len(target)) for j in range(combos.shape[1]))
        out[0] = 0
        return out

    x = np.zeros(len(combos))
    if not len(combos):
        return x
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = forward(v / np.linalg.norm(v))[combos].sum(axis=1)
    step, y, t = 1 / (1.05 * np.linalg.norm(v)), x, 1.0
    for _ in range(rounds):
        residual = target - forward(y)
        residual[0] = 0
        new = np.maximum(y + step * residual[combos].sum(axis=1), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


class Pool:
    """Tails still to place: by length left, runs [tail length, tokens placed before, first rank, count]."""

    def __init__(self, histogram: np.ndarray):
        self.runs = {int(n): [[int(n), 0, 0, int(histogram[n])]] for n in np.flatnonzero(histogram) if n}
        self.lengths = sorted(self.runs)
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []
        self.sequences = 0

    def longest(self, most: int, used: dict[int, int]) -> int:
        """The longest length up to most of which a run has more left than is used already; 0: none."""
        i = bisect.bisect_right(self.lengths, most) - 1
        while i >= 0:
            n = self.lengths[i]
            if self.runs[n][-1][3] > used.get(n, 0):
                return n
            i -= 1
        return 0

    def drop_empty(self, n: int) -> None:
        self.runs[n] = [r for r in self.runs[n] if r[3]]
        if not self.runs[n]:
            del self.runs[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))

    def place(self, parts: list[int], cut: tuple[int, int] | None, most: int) -> int:
        """Repeats the sequence of the given lengths, and perhaps a cut (length, tokens of it), as often as runs allow."""
        uses: dict[int, int] = {}
        for n in [*parts, *([cut[0]] if cut else [])]:
            uses[n] = uses.get(n, 0) + 1
        repeats = min(most, *(self.runs[n][-1][3] // k for n, k in uses.items())) if all(n in self.runs for n in uses) else 0
        if repeats <= 0:
            return 0
        offset, left = 0, []
        for n, g in [*((n, n) for n in parts), *([cut] if cut else [])]:
            run = self.runs[n][-1]
            self.rows.append((run[0], run[1], g, run[2], repeats, self.sequences, offset))
            if g < n:
                left.append((n - g, [run[0], run[1] + g, run[2], repeats]))
            run[2] += repeats
            run[3] -= repeats
            offset += g
        for n in uses:
            self.drop_empty(n)
        for n, run in left:
            if n not in self.runs:
                bisect.insort(self.lengths, n)
            self.runs.setdefault(n, []).append(run)
        self.sequences += repeats
        return repeats


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Rows (tail length, start in the tail, tokens, first rank, count, first sequence, offset) and the number of sequences.

    A tail of that length whose rank is within the run lies, from that start, in the sequence that
    many after the first. The work depends on the window, not on the number of tails.
    """
    pool = Pool(histogram)
    combos = combinations(window, histogram)
    x = solve(combos, histogram)
    for j in np.argsort(-x, kind="stable"):
        repeats = int(x[j] + 0.5)
        if repeats <= 0:
            break
        pool.place([int(n) for n in combos[j] if n], None, repeats)
    while pool.lengths:
        parts, used, gap, cut = [], {}, window, None
        while gap and (n := pool.longest(gap, used)):
            parts.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap >= LEAST_CUT and ((total := window - gap) & (total - 1)):
            i = len(pool.lengths) - 1
            while i >= 0 and pool.lengths[i] > gap:
                n = pool.lengths[i]
                if pool.runs[n][-1][3] > used.get(n, 0):
                    cut = (n, gap)
                    break
                i -= 1
            if cut is None:  # the last tails: a sequence as long as a power of two, then what is left
                room, whole = 1 << (total.bit_length() - 1), []
                for n in parts:
                    if n > room:
                        cut = (n, room) if room else None
                        break
                    whole.append(n)
                    room -= n
                pool.place(whole, cut, 1)
                continue
        pool.place(parts, cut, 1 << 62)
    return pool.rows, pool.sequences


def _pieces(ids: pa.Array, which: np.ndarray, start: np.ndarray, length: np.ndarray, doc_tokens: np.ndarray, sequence: np.ndarray, offset: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """A row for each piece; data has the ids of all pieces one after another."""
    ends = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, doc_tokens, sequence, offset)), binary], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


class Chunk:
    """Tails of texts that wait for their plan."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, ids: pa.Array, doc_tokens: np.ndarray, start: np.ndarray, tail: np.ndarray, data: np.ndarray) -> None:
        self.parts.append((ids, doc_tokens, start, tail, data))
        self.tokens += len(data)

    def packed(self, window: int, first_sequence: int) -> tuple[Iterator[pa.RecordBatch], int]:
        """The pieces of all tails, and the number of sequences they fill."""
        ids = pa.concat_arrays([p[0] for p in self.parts])
        doc_tokens, start, tail, data = (np.concatenate([p[k] for p in self.parts]) for k in range(1, 5))
        self.__init__()
        rows, n = plan(np.bincount(tail[tail > 0], minlength=window), window)
        if not rows:
            return iter(()), 0
        length, begin, tokens, rank, count, sequence, offset = np.array(sorted(rows, key=lambda r: r[5]), dtype=np.int64).T
        order = np.argsort(tail, kind="stable")
        where, k = K.ragged(np.searchsorted(tail[order], length) + rank, count)
        which, row = order[where], np.repeat(np.arange(len(rows)), count)
        base = np.concatenate([[0], np.cumsum(tail)])[:-1]

        def batches() -> Iterator[pa.RecordBatch]:
            for low in range(0, len(which), BATCH_PIECES):
                w, r, j = (x[low : low + BATCH_PIECES] for x in (which, row, k))
                at, _ = K.ragged(base[w] + begin[r], tokens[r])
                yield _pieces(ids, w, start[w] + begin[r], tokens[r], doc_tokens[w], first_sequence + sequence[r] + j, offset[r], data[at])

        return batches(), n


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, chunk_tokens: int = CHUNK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all texts into sequences of at most ``window`` tokens: a row for each piece with id_col, start, length,
    doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A text is its ids followed by end_id, so an empty or null text is a piece of one id. Windows
    that one text fills are sequences of their own and leave at once; what is left of each text, its
    tail, waits until its task has ``chunk_tokens`` of tails, which are then placed by plan() from
    the histogram of their lengths. So a task holds one chunk, nothing is shuffled or sent to
    the driver, and a lost task is done again by itself. What no combination fills is cut to sequences
    whose lengths are powers of two, which are not padded; others are to be padded to
    the window. Repeated and null ids and rows are packed like any others; an empty table gives no piece;
    very long texts are windows but for their tail; other columns of docs are not read.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n_sequences, chunk = encoder(shared), TaskContext.get().partitionId() << 40, Chunk()
        for batch in batches:
            for first, last, raw, offsets in K.blocks(batch.column(1)):
                coded, begin = model.encode(raw, offsets)
                n = np.diff(begin) + 1
                upto = np.concatenate([[0], np.cumsum(n)])
                own = np.full(upto[-1], end_id, dtype="<u4")
                own[np.arange(len(coded)) + np.repeat(np.arange(len(n)), n - 1)] = coded
                ids, full, tail = batch.column(0).slice(first, last - first), n // window, n % window
                which, place = K.ragged(np.zeros(len(n), np.int64), full)
                which = np.repeat(np.arange(len(n)), full)
                for low in range(0, len(which), BATCH_PIECES):
                    w, start = which[low : low + BATCH_PIECES], place[low : low + BATCH_PIECES] * window
                    at, _ = K.ragged(upto[w] + start, np.full(len(w), window))
                    yield _pieces(ids, w, start, np.full(len(w), window), n[w], n_sequences + np.arange(len(w)), np.zeros(len(w)), own[at])
                    n_sequences += len(w)
                at, _ = K.ragged(upto[:-1] + full * window, tail)
                chunk.add(ids, n, full * window, tail, own[at])
                if chunk.tokens >= chunk_tokens:
                    packed, used = chunk.packed(window, n_sequences)
                    yield from packed
                    n_sequences += used
        if chunk.parts:
            yield from chunk.packed(window, n_sequences)[0]

    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(fill, f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)


def with_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
