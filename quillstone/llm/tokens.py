"""Token counts by public tokenizers, in Arrow tasks that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import kernels as K

#: Bytes of text given to the tokenizer library at once.
ENCODE_BYTES = 1 << 17
#: A Python worker finds the ids of so many pieces by their bytes; a newer piece takes the place of an older one. With more
#: ids or bytes than so many it forgets them all.
REMEMBERED = 1 << 20
REMEMBERED_IDS = 1 << 22
REMEMBERED_BYTES = 1 << 24

_MARK = K.byte_class([(ord(c), ord(c)) for c in ",.;:!?"])
_LETTER = K.byte_class([(0x41, 0x5A), (0x61, 0x7A)])


def read_tokenizer(path: str) -> tuple[str, bytes]:
    """Kind and content of a vocabulary file on the driver. A vocabulary has a fixed size, so it may be broadcast."""
    with open(path, "rb") as f:
        return ("sentencepiece" if path.endswith(".model") else "tokenizers"), f.read()


def safe_cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in raw where every piece begins: each non-empty text; each space or line feed after a character that is
    no white space; and each of ``,.;:!?`` after an ASCII letter. A byte-level pre-tokenizer never joins what lies on
    both sides of such a place."""
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[at > 0]
    p1, p2, p3 = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    wide_space = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & ((p2 == 0x80) | (p2 == 0x81) | (p2 == 0x9A)))
    solid = ((p1 > 0x20) & (p1 < 0x7F)) | ((p1 >= 0x80) & ~wide_space)
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[at[solid]] = True
    begins[1:-1] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    begins[offsets[:-1]] = True
    begins[-1] = False
    return np.flatnonzero(begins)


class Encoder:
    """Encodes blocks of texts; a piece that occurred before is looked up."""

    def __init__(self, kind: str, content: bytes):
        self.kind = kind
        if kind == "sentencepiece":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(content.decode())
            self.model.no_truncation()
            self.model.no_padding()
            pre = self.model.pre_tokenizer.__class__.__name__ if self.model.pre_tokenizer else ""
            self.cuttable = pre == "ByteLevel" and self.model.normalizer is None and not self.model.pre_tokenizer.add_prefix_space
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(REMEMBERED, dtype=np.uint64)
        self.slots = np.full(REMEMBERED, -1, dtype=np.int32)
        self.data = np.zeros(1 << 20, dtype=np.uint8)  # the bytes of each slot's piece, and where they end
        self.bounds = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)
        self.n = 0

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [piece.decode() for piece in pieces]
        if self.kind == "sentencepiece":
            coded = self.model.encode(texts, num_threads=1)
        else:
            coded = [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ends = int(self.ends[self.n]) + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        bounds = int(self.bounds[self.n]) + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        while bounds[-1] > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(coded) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.data[bounds[-1] - len(data) : bounds[-1]] = data
        self.bounds[self.n + 1 : self.n + 1 + len(coded)] = bounds
        low = int(self.ends[self.n])
        self.ids[low : ends[-1]] = np.fromiter(chain.from_iterable(coded), np.uint32, int(ends[-1]) - low)
        self.ends[self.n + 1 : self.n + 1 + len(coded)] = ends
        self.n += len(coded)

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece its slot, found by its bytes; for each text its first piece (one more at the end)."""
        if self.kind == "sentencepiece" or not self.cuttable:
            starts = offsets[:-1][np.diff(offsets) > 0]
        else:
            starts = safe_cuts(raw, offsets)
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), first
        if self.ends[self.n] > REMEMBERED_IDS or self.bounds[self.n] > REMEMBERED_BYTES:
            self.forget()
        ends = np.append(starts[1:], len(raw))  # pieces follow one another without a gap
        keys = K.span_hashes(raw, starts, ends)
        slots = self._look_up(raw, starts, ends - starts, keys)
        missed = np.flatnonzero(slots < 0)
        if len(missed):
            bounds = np.append(starts, len(raw)).astype(np.int64)
            every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
            new = every.take(pa.array(missed)).dictionary_encode()
            which, base, batch, size = new.indices.to_numpy(), self.n, [], 0
            for piece in new.dictionary.to_pylist():
                batch.append(piece)
                size += len(piece)
                if size >= ENCODE_BYTES:
                    self._learn(batch)
                    batch, size = [], 0
            if batch:
                self._learn(batch)
            slots[missed] = base + which
            _, first_of = np.unique(which, return_index=True)
            self._remember(keys[missed[first_of]], np.arange(base, self.n))
        return slots, first

    def _remember(self, keys: np.ndarray, slots: np.ndarray) -> None:
        one, two = ((keys >> np.uint64(s) & np.uint64(REMEMBERED - 1)).astype(np.int64) for s in (0, 32))
        place = np.where(self.slots[one] < 0, one, two)
        self.keys[place] = keys
        self.slots[place] = slots

    def _look_up(self, raw: np.ndarray, starts: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 if it isn't there. Hashes only name a slot; the bytes decide."""
        one, two = ((keys >> np.uint64(s) & np.uint64(REMEMBERED - 1)).astype(np.int64) for s in (0, 32))
        place = np.where(self.keys[one] == keys, one, two)
        slots = np.where(self.keys[place] == keys, self.slots[place], -1).astype(np.int64)
        begin = self.bounds[slots]
        slots[(slots >= 0) & (self.bounds[slots + 1] - begin != n)] = -1
        there = np.flatnonzero(slots >= 0)
        at, offset = K.ragged(starts[there], n[there])
        other = raw[at] != self.data[offset + np.repeat(begin[there], n[there])]
        slots[there[K.sums(other.astype(np.uint64), n[there]) > 0]] = -1
        return slots

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        slots, first = self.pieces(raw, offsets)
        total = np.concatenate([[0], np.cumsum(self.ends[slots + 1] - self.ends[slots])])
        return total[first[1:]] - total[first[:-1]]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins in them."""
        slots, first = self.pieces(raw, offsets)
        low = self.ends[slots]
        n = self.ends[slots + 1] - low
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(total[-1]) + np.repeat(low - total[:-1], n)
        return self.ids[place], total[first]


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    if shared.value[2] not in _encoders:
        _encoders.clear()
        _encoders[shared.value[2]] = Encoder(*shared.value[:2])
    return _encoders[shared.value[2]]


def share_tokenizer(spark: SparkSession, path: str):
    kind, content = read_tokenizer(path)
    return spark.sparkContext.broadcast((kind, content, f"{path}:{len(content)}"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of each whole text: id_col, n_bytes, n_tokens, over_limit.

    Rows keep their number and order; nothing is shuffled. Null text counts as empty: no bytes, no
    tokens. Null and repeated ids stay as they are; other columns of docs are not read. Long texts
    are cut at places that the pre-tokenizer never joins (see safe_cuts), so counts are those of
    the whole text; a long text without such a place is encoded whole. Vocabularies with another
    pre-tokenizer are never cut.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    id_field = docs.schema[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(shared)
        for batch in batches:
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, offsets in K.blocks(batch.column(1)):
                n_bytes.append(np.diff(offsets))
                n_tokens.append(model.lengths(raw, offsets))
            tokens = np.concatenate(n_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_bytes)), pa.array(tokens), pa.array(tokens > limit)], [id_field.name, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_field.name}` {id_field.dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
