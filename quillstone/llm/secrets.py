"""Secret scans in SQL expressions only: fixed patterns, and sliding-window entropy of candidate strings.

Positions and counts come out of folds over arrays. A fold that appended each result to one array would copy that
array each time, so folds run over blocks of BLOCK elements (see _scan): work grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, with the group whose length counts and the least length. Where a pattern
#: matches maximal runs, the least length is part of the pattern.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes: the pattern of a whole candidate, whether it needs a digit, and the least entropy of a window in bits.
#: A candidate belongs to the first that fits; the last one takes all that is left, so none goes unmeasured.
CLASSES = [
    ("hex", r"^(?:[0-9a-f]*[a-f][0-9a-f]*|[0-9A-F]*[A-F][0-9A-F]*)$", True, 3.0),
    ("base32", r"^[A-Z2-7]*[A-Z][A-Z2-7]*=*$", True, 3.5),
    ("lower", r"^[a-z0-9]+$", True, 3.6),
    ("upper", r"^[A-Z0-9]+$", True, 3.6),
    ("base64", r"[A-Z][^A-Z]*[a-z]|[a-z][^a-z]*[A-Z]", True, 3.8),
    ("other", r"^", False, 4.1),
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Candidates that are known not to be secrets: placeholders, alphabets in order, and UUIDs.
ALLOWED = [r"(?i)example|placeholder|dummy|changeme|redacted|x{6}", r"(?i)0123456789|123456789|abcdefghijkl|qwertyuiop", r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"]

SPAN = "struct<start:int,end:int,rank:int,kind:string,value:string>"
BLOCK = 256
#: Counters of five bits each that one long holds.
PACKED = 12


def _sql(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, kind: str, value: str, grow: Callable[[str, str], str], when: str, emit: str) -> str:
    """What each item x emits, seeing the total of all items before it: expressions over x and a.total.

    Totals (sums or maxima of ``value``, non-negative integers) are taken block by block; each block then begins with the
    total of those before it.
    """
    total = f"aggregate(b, 0, (a, x) -> {grow('a', value)})"
    before = f"aggregate(transform(blocks, b -> {total}), named_struct('total', 0, 'out', cast(array() AS array<int>)), (a, n) -> named_struct('total', {grow('a.total', 'n')}, 'out', concat(a.out, array(a.total))), a -> a.out)"
    step = f"(a, x) -> named_struct('total', {grow('a.total', value)}, 'out', if({when}, concat(a.out, array({emit})), a.out))"
    each = f"transform(blocks, (b, i) -> aggregate(b, named_struct('total', before[i], 'out', cast(array() AS array<{kind}>)), {step}, a -> a.out))"
    cut = f"transform(sequence(0, (size(items) - 1) div {BLOCK}), i -> slice(items, i * {BLOCK} + 1, {BLOCK}))"
    some = _let(cut, "blocks", _let(before, "before", f"flatten({each})"))
    return _let(items, "items", f"CASE WHEN size(items) > 0 THEN {some} ELSE cast(array() AS array<{kind}>) END")


def _matches(pattern: str, rank: int, kind: str, group: int, least: int) -> str:
    """Spans of the leftmost non-overlapping matches in column t, from the lengths of the matches and of what lies between."""
    p = _sql(pattern)
    parts = f"regexp_extract_all(t, {p}, {group})" if group else "m.wholes"
    lets = f"named_struct('gaps', split(t, {p}, -1), 'wholes', regexp_extract_all(t, {p}, 0))"
    item = "named_struct('gap', length(m.gaps[i]), 'size', length(w), 'part', length(parts[i]), 'value', w)"
    items = _let(lets, "m", _let(parts, "parts", f"transform(m.wholes, (w, i) -> {item})"))
    span = f"named_struct('start', a.total + x.gap, 'end', a.total + x.gap + x.size, 'rank', {rank}, 'kind', '{kind}', 'value', x.value)"
    return f"CASE WHEN t RLIKE {p} THEN {_scan(items, SPAN, 'x.gap + x.size', lambda a, n: f'{a} + {n}', f'x.part >= {least}', span)} ELSE cast(array() AS array<{SPAN}>) END"


def _windows(value: str, least: str) -> str:
    """First start and last end of the windows of a string that have so much entropy.

    The window moves by a character: the counter of the one that enters grows, that of the one that
    leaves shrinks, and s, the sum of c * log2(c), changes by these two terms. Counters lie in
    PACKED-fold longs, five bits each, so a step costs the same whatever the alphabet.
    """
    words = -(-(len(ALPHABET) + 1) // PACKED)
    terms = "array(" + ", ".join(f"{c * log2(c) if c else 0.0!r}D" for c in range(WINDOW + 2)) + ")"
    codes = f"transform(split({value}, ''), c -> instr('{ALPHABET}', c))"
    unit = lambda c: f"shiftleft(1L, 5 * ({c} % {PACKED}))"
    count = lambda c: f"cast(shiftright(a.counts[{c} div {PACKED}], 5 * ({c} % {PACKED})) & 31 AS int)"
    moved = f"transform(a.counts, (w, j) -> w + if(j = e.new div {PACKED}, {unit('e.new')}, 0L) - if(e.old >= 0 AND j = e.old div {PACKED}, {unit('e.old')}, 0L))"
    counts = f"named_struct('cin', {count('e.new')}, 'cout', if(e.old >= 0, {count('e.old')}, 0))"
    now = "a.s + if(e.new = e.old, 0D, k.f[c.cin + 1] - k.f[c.cin] + if(e.old < 0, 0D, k.f[c.cout - 1] - k.f[c.cout]))"
    passes = f"i >= {WINDOW - 1} AND {log2(WINDOW)!r}D - s / {WINDOW} >= k.least - 1e-9D"
    state = f"named_struct('counts', {moved}, 's', s, 'low', if({passes} AND a.low < 0, i - {WINDOW - 1}, a.low), 'high', if({passes}, i + 1, a.high))"
    step = f"(a, i) -> {_let(f'''named_struct('new', k.codes[i], 'old', if(i < {WINDOW}, -1, k.codes[i - {WINDOW}]))''', 'e', _let(counts, 'c', _let(now, 's', state)))}"
    zero = f"named_struct('counts', array_repeat(0L, {words}), 's', 0D, 'low', -1, 'high', -1)"
    return _let(f"named_struct('codes', {codes}, 'f', {terms}, 'least', {least})", "k", f"aggregate(sequence(0, size(k.codes) - 1), {zero}, {step}, a -> named_struct('low', a.low, 'high', a.high))")


def secret_spans(docs: DataFrame, allowed: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in each whole text: id_col, base (spans of KINDS), added (entropy spans), each an array of structs start,
    end, rank, kind, value by start and rank; positions are code points, the end exclusive.

    Entropy spans run from the first to the last window of WINDOW characters of a candidate string
    whose entropy reaches that of its character class; a candidate must not match the allow list.
    Entropy spans inside a base span are dropped. Row by row: nothing is shuffled, rows and repeated
    ids stay, null text is empty, other columns are not read, very long texts take time in
    proportion. All of it is SQL expressions in the scan's own stage.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = [F.expr(_matches(p, i, kind, group, least)) for i, (kind, p, group, least) in enumerate(KINDS)]
    t = t.select("id", F.array_sort(F.concat(*base)).alias("base"), F.expr(_matches(CANDIDATE, len(KINDS), "entropy", 0, WINDOW)).alias("found"))
    not_allowed = " AND ".join(f"NOT x.value RLIKE {_sql(p)}" for p in (ALLOWED if allowed is None else allowed)) or "true"
    least = "CASE " + " ".join(f"WHEN x.value RLIKE {_sql(whole)}{' AND x.value RLIKE ' + _sql('[0-9]') if digit else ''} THEN {bits}D" for _, whole, digit, bits in CLASSES) + " END"
    shape = "if(x.value RLIKE '^[0-9A-F]+$', lower(x.value), x.value)"
    measured = f"transform(filter(found, x -> {not_allowed}), x -> named_struct('x', x, 'w', {_windows(shape, least)}))"
    t = t.withColumn("found", F.expr(f"filter({measured}, y -> y.w.low >= 0)"))
    late = "named_struct('start', y.x.start + y.w.low, 'late', true, 'end', y.x.start + y.w.high, 'value', substring(y.x.value, y.w.low + 1, y.w.high - y.w.low))"
    early = "named_struct('start', b.start, 'late', false, 'end', b.end, 'value', '')"
    every = f"array_sort(concat(transform(base, b -> {early}), transform(found, y -> {late})))"
    span = f"named_struct('start', x.start, 'end', x.end, 'rank', {len(KINDS)}, 'kind', 'entropy', 'value', x.value)"
    # a base span that begins no later and ends no sooner holds the entropy span: the largest end so far tells
    free = _scan(every, SPAN, "if(x.late, 0, x.end)", lambda a, n: f"greatest({a}, {n})", "x.late AND a.total < x.end", span)
    return t.select(F.col("id").alias(id_col), "base", F.expr(f"CASE WHEN size(found) > 0 THEN {free} ELSE cast(array() AS array<{SPAN}>) END").alias("added"))


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
