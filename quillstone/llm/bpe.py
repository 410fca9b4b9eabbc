"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one last token in its encoding. Of the tokens that end at a place (a suffix automaton over the
vocabulary finds them), it is the one that is compatible with the last token of the prefix before it. Following the
stored tokens back from the end gives the word's ids, those that merging by rank gives, in time linear in the word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import kernels as K
from quillstone.llm.tokens import Encoder

#: A worker remembers the ids of so many words, and the answers for so many pairs of tokens; then it starts anew.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 1 << 15, 1 << 18
#: What stands between pieces whose words are found together; no piece of printable characters and white space has it.
BETWEEN = "\x01"


def suffix_automaton(words: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Moves, suffix links and longest lengths of the states of an automaton over all substrings of the words."""
    go: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def new(moves: dict[int, int], to: int, length: int) -> int:
        go.append(moves)
        link.append(to)
        longest.append(length)
        return len(go) - 1

    def redirect(p: int, c: int, q: int) -> int:
        """The state for the strings of q that are no longer than p's and c: q itself, or a part split off."""
        if longest[q] == longest[p] + 1:
            return q
        part = new(dict(go[q]), link[q], longest[p] + 1)
        link[q] = part
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = part
            p = link[p]
        return part

    for word in words:
        last = 0
        for c in word:
            if c in go[last]:
                last = redirect(last, c, go[last][c])
                continue
            state, p = new({}, 0, longest[last] + 1), last
            while p >= 0 and c not in go[p]:
                go[p][c] = state
                p = link[p]
            if p >= 0:
                link[state] = redirect(p, c, go[p][c])
            last = state
    return go, link, longest


def compatible(merge: dict[int, int], left: list[int], right: list[int], symbols: int, a: int, b: int, limit: int) -> bool:
    """Whether the strings of tokens a and b side by side are encoded as a, b.

    Tokens are numbered in the order of their merges. The younger of the two neighbours is taken apart
    step by step; where a merge across the border is older than what it would have prevented, it would have come first.
    A merge of the same rank comes first if it lies further left.
    """
    while True:
        across = merge.get(a << 20 | b)
        if across is not None and across < limit:
            return False
        if a > b:
            if a < symbols:
                return True
            limit, a = a, right[a]
        else:
            if b < symbols:
                return True
            limit, b = b + 1, left[b]


@dataclass
class Vocabulary:
    """What workers need, in flat arrays; of a fixed size, so that it may be broadcast."""

    content: str  # the tokenizer's own file, for its normalizer and pre-tokenizer
    symbols: dict[str, int]  # characters, and those with the ending of a word
    ending: str
    ids: np.ndarray  # the vocabulary's id of each token, numbered in the order of merges
    left: np.ndarray
    right: np.ndarray
    moves: np.ndarray  # state << 10 | symbol, ascending
    targets: np.ndarray
    link: np.ndarray
    longest: np.ndarray
    token_state: np.ndarray  # for each token the state in which it ends, -1 for tokens that no encoding has
    token_length: np.ndarray
    special: dict[str, int]
    strings: list[str]  # by id
    bytewise: bool  # whether decoding maps characters back to bytes


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizers file with a BPE model on the driver and builds its automaton. Dropout, unknown tokens, prefixes of
    continuing parts, fallback to bytes and whole-word lookup are refused; each merge must make a token of its own."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    parsed = json.loads(content)
    model, vocab = parsed["model"], parsed["model"]["vocab"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path}: only plain BPE models are encoded")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in parsed["added_tokens"]):
        raise ValueError(f"{path}: only plain added tokens are found")
    if parsed["decoder"] and parsed["decoder"]["type"] != "ByteLevel":
        raise ValueError(f"{path}: only tokens or bytes are decoded")
    ending = model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    made = {a + b for a, b in merges}
    if len(made) < len(merges):
        raise ValueError(f"{path}: two merges make one token")
    base = sorted((s for s in vocab if s not in made and s not in special), key=vocab.get)
    number = {s: i for i, s in enumerate([*base, *(a + b for a, b in merges)])}
    n = len(base)
    if len(number) >= 1 << 20 or n >= 1 << 10:
        raise ValueError(f"{path}: too many tokens or symbols")
    left, right = ([*range(n), *(number[m[k]] for m in merges)] for k in (0, 1))
    merge = {left[t] << 20 | right[t]: t for t in range(n, len(number))}
    spelled: list[tuple[int, ...]] = [(t,) for t in range(n)]
    valid = [True] * n
    for t in range(n, len(number)):
        spelled.append(spelled[left[t]] + spelled[right[t]])
        valid.append(valid[left[t]] and valid[right[t]] and compatible(merge, left, right, n, left[t], right[t], t))
    go, link, longest = suffix_automaton(spelled)
    ends = []
    for t, word in enumerate(spelled):
        state = 0
        for c in word:
            state = go[state][c]
        ends.append(state if valid[t] else -1)
    moves = np.array([state << 10 | c for state, of in enumerate(go) for c in of], np.int64)
    targets = np.array([to for of in go for to in of.values()], np.int32)
    order = np.argsort(moves)
    by_id = {i: s for s, i in [*vocab.items(), *special.items()]}
    strings = [by_id.get(i, "") for i in range(max(by_id) + 1)]
    return Vocabulary(content, {s: i for i, s in enumerate(base)}, ending, np.array([vocab[s] for s in number], np.int32), np.array(left, np.int32), np.array(right, np.int32), moves[order], targets[order], np.array(link, np.int32), np.array(longest, np.int32), np.array(ends, np.int32), np.array([*map(len, spelled)], np.int32), special, strings, parsed["decoder"] is not None)


class Coded:
    def __init__(self, ids: list[int]):
        self.ids = ids


class PrefixModel:
    """Encodes texts; the tokenizer's own normalizer and pre-tokenizer make words of them."""

    def __init__(self, v: Vocabulary):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(v.content)
        self.symbols, self.ending, self.n = v.symbols, v.ending, len(v.symbols)
        self.ids, self.left, self.right = v.ids.tolist(), v.left.tolist(), v.right.tolist()
        self.merge = {a << 20 | b: t for t, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if t >= self.n}
        self.go = dict(zip(v.moves.tolist(), v.targets.tolist(), strict=True))
        self.link, self.longest = v.link.tolist(), v.longest.tolist()
        self.ending_at: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        own: dict[int, list[tuple[int, int]]] = {}
        for t in np.argsort(-v.token_length, kind="stable").tolist():  # the longest first
            if v.token_state[t] >= 0:
                own.setdefault(int(v.token_state[t]), []).append((int(v.token_length[t]), t))
        for state in np.argsort(v.longest, kind="stable").tolist()[1:]:
            rest = self.ending_at[self.link[state]]
            self.ending_at[state] = (*own[state], *rest) if state in own else rest
        self.special = v.special
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.plain = plain_pattern(v.content)

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = compatible(self.merge, self.left, self.right, self.n, a, b, 1 << 20)
        return known

    def word(self, text: str) -> list[int]:
        """The ids of one word."""
        if (known := self.words.get(text)) is not None:
            return known
        symbols = [self.symbols[c] for c in text]
        if self.ending:
            symbols[-1] = self.symbols[text[-1] + self.ending]
        last, size = [-1], [0]  # of each prefix the last token and its length
        state = length = place = 0
        go, pairs, ending_at, fits = self.go.get, self.pairs.get, self.ending_at, self.fits
        for c in symbols:
            place += 1
            while (to := go(state << 10 | c)) is None:
                state = self.link[state]
                length = self.longest[state]
            state = to
            length += 1
            for n, t in ending_at[state]:
                if n <= length:
                    if n == place:
                        break
                    before = last[place - n]
                    if (known := pairs(before << 20 | t)) or known is None and fits(before, t):
                        break
            last.append(t)
            size.append(n)
        out = []
        while place:
            out.append(self.ids[last[place]])
            place -= size[place]
        out.reverse()
        if len(text) <= 64:
            if len(self.words) >= REMEMBERED_WORDS:
                self.words.clear()
            self.words[text] = out
        return out

    def _plain(self, text: str) -> list[int]:
        if self.own.normalizer is not None:
            text = self.own.normalizer.normalize_str(text)
        words = [w for w, _ in self.own.pre_tokenizer.pre_tokenize_str(text)] if self.own.pre_tokenizer is not None else [text]
        return [t for w in words if w for t in self.word(w)]

    def text(self, text: str) -> list[int]:
        """The ids of a text; special tokens in it are found first, the leftmost and then the longest."""
        out, begin = [], 0
        while self.special:
            at, minus_length, name = min(((text.find(s, begin), -len(s), s) for s in self.special if text.find(s, begin) >= 0), default=(-1, 0, ""))
            if at < 0:
                break
            out += self._plain(text[begin:at]) if at > begin else []
            out.append(self.special[name])
            begin = at - minus_length
        return out + (self._plain(text[begin:]) if begin < len(text) else [])

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[Coded]:
        """The ids of many texts; words of those in plain ASCII are found in one go."""
        if self.plain is None:
            return [Coded(self.text(t)) for t in texts]
        pattern, lower = self.plain
        simple = [ODD.search(t) is None and not any(s in t for s in self.special) for t in texts]
        joined = f"\n{BETWEEN}\n".join(t for t, s in zip(texts, simple, strict=True) if s)
        words = iter(pattern.findall(joined.lower() if lower else joined))
        out = []
        for text, s in zip(texts, simple, strict=True):
            if s:
                ids: list[int] = []
                for w in words:
                    if w == BETWEEN:
                        break
                    ids += self.word(w)
                out.append(Coded(ids))
            else:
                out.append(Coded(self.text(text)))
        return out


ODD = re.compile(r"[^\x20-\x7e\t\n\r]")


def plain_pattern(content: str) -> tuple[re.Pattern, bool] | None:
    """For printable ASCII texts the pattern of words as this module's own, and whether A-Z become lower case; None if the
    tokenizer isn't known to be no more than that: its normalizers compose, fold white space or lower the case, and its
    pre-tokenizer keeps what the pattern, which knows letters, numbers and white space, matches."""
    parsed = json.loads(content)
    steps = (parsed["normalizer"] or {}).get("normalizers", [])
    pre = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [p["type"] for p in pre] != ["Split", "ByteLevel"] or any(x["type"] not in ("NFC", "Replace", "Lowercase") for x in steps):
        return None
    if any(x["type"] == "Replace" and (x["pattern"].get("Regex"), x["content"]) != (r"\s+", " ") for x in steps):
        return None
    split, level = pre
    pattern = split["pattern"].get("Regex", "")
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    # Only alternatives that can't match white space: then folding it changes nothing, and a word never leaves its piece.
    if re.sub(r"'[a-z]+|\[(?:\^\\s)?(?:\\p\{[LN]\})+\]\+?", "", pattern).strip("|"):
        return None
    return re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII), any(x["type"] == "Lowercase" for x in steps)


class PrefixEncoder(Encoder):
    """Encodes blocks of texts piece by piece; pieces that occurred before are looked up.

    Pieces begin at white space or punctuation after a character that neither joins (see safe_cuts).
    A normalizer that works on single characters, or composes them with marks that follow, changes nothing across
    such a place, and a pre-tokenizer that parts words there sees each word whole.
    """

    def __init__(self, v: Vocabulary):
        self.kind, self.model = "tokenizers", PrefixModel(v)
        pre = self.model.own.pre_tokenizer
        self.cuttable = bool(v.ending) or pre.__class__.__name__ == "ByteLevel" and self.model.own.normalizer is None and not pre.add_prefix_space
        self.forget()


_models: dict[str, PrefixEncoder] = {}


def _encoder(shared) -> PrefixEncoder:
    name, v = shared.value
    if name not in _models:
        _models.clear()
        _models[name] = PrefixEncoder(v)
    return _models[name]


def share_vocabulary(spark: SparkSession, path: str):
    v = read_vocabulary(path)
    return spark.sparkContext.broadcast((f"{path}:{len(v.content)}", v))


def encode(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """id_col and ids_col, the ids of each whole text by a vocabulary of share_vocabulary().

    The ids are those of the tokenizers library without added special tokens: special strings in a
    text become their ids. Null and empty texts have none. Rows keep their number and order, repeated and null ids
    stay as they are, other columns aren't read, and nothing is shuffled. Long texts are cut between words only.
    """
    field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(vocabulary)
        for batch in batches:
            for first, last, raw, offsets in K.blocks(batch.column(1)):
                ids, begins = model.encode(raw, offsets)
                each = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), each], [field.name, ids_col])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, `{ids_col}` array<int>")


def _byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def decode(encoded: DataFrame, vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col, the text of ids_col: its tokens joined by spaces or, where the vocabulary's decoder maps
    characters to bytes, the bytes. Special tokens are kept. Ids that the vocabulary lacks are left out, as the library
    does; null ids are none. out_col must be free."""
    if out_col in encoded.columns:
        raise ValueError(f"{out_col} is taken")
    names = encoded.columns
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value[1]
        strings, known = pa.array(v.strings), np.array([s != "" for s in v.strings])
        of = _byte_of_character()
        parts = [bytes(of[c] for c in s) if s not in v.special and all(c in of for c in s) else s.encode() for s in v.strings] if v.bytewise else []
        for batch in batches:
            lists = batch.column(place)
            begins = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            there = (ids >= 0) & (ids < len(known))
            there[there] &= known[ids[there]]
            if not there.all():
                begins, ids = np.concatenate([[0], np.cumsum(there)])[begins], ids[there]
            if v.bytewise:
                out = pa.array([b"".join(parts[i] for i in ids[a:b]).decode(errors="replace") for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], pa.string())
            else:
                out = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), strings.take(pa.array(ids))), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, `{out_col}` string")
