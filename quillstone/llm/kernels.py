"""Vectorised text helpers that run inside Arrow tasks.

Each helper looks at the UTF-8 bytes of a whole Arrow batch at once: words, lines and their hashes
come out of a few numpy passes, without a Python object for each word. Batches are cut into blocks
of a bounded number of bytes, so that the scratch arrays stay small however long a batch is; a
single text longer than a block is a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true within the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes between the words ``[^\x20\x09-\x0D]+``.
SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes between the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z became a-z.
NOT_ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets) with null as empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    if len(raw) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~between[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_PLACE_KEYS = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _M2)


def _place_keys(place: np.ndarray, longest: int) -> np.ndarray:
    """A key for each place of a span; those of the first 65,536 are kept."""
    if longest <= len(_PLACE_KEYS):
        return _PLACE_KEYS[place]
    return mix((place + 1).astype(np.uint64) * _M2)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end] for ascending spans that don't overlap, the same wherever the span lies.

    Each byte is mixed with its place in the span, and the mixed values are added up. There is no
    polynomial in it, so no family of strings collides by construction. Empty spans are allowed.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = ends - starts
    upto = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
    data = raw[: upto[-1]] if starts[0] == 0 and ends[-1] == upto[-1] else raw[place + np.repeat(starts, n)]
    v = (_BYTE_KEYS[data] ^ _place_keys(place, int(n.max()))) * _GOLD
    v ^= v >> _S33
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
    return mix(total[upto[1:]] - total[upto[:-1]] + n.astype(np.uint64))


def ragged(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of ranges of n places from each start, one after another, and each one's place in its range."""
    upto = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
    return place + np.repeat(starts, n), place


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive groups of n values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    upto = np.concatenate([[0], np.cumsum(n)])
    return total[upto[1:]] - total[upto[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each place where k words are left in the array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += mix(words[j : j + n] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
