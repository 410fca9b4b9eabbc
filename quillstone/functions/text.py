"""Columns over file contents and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import constants as C


def n_lines(text: Column) -> Column:
    """Lines of a text: line feeds, and one more where the last line has none; 0 for an empty text."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def line_lengths(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), F.length)


def longest_line(text: Column) -> Column:
    return F.array_max(line_lengths(text)).cast("long")


def mean_line(text: Column) -> Column:
    sizes = line_lengths(text)
    return F.when(text == "", F.lit(0.0)).otherwise(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size(sizes))


def skip_reason(size: Column, text: Column, is_supported: Column) -> Column:
    """Why a file is not parsed; null if it is."""
    return (
        F.when(size > C.MAX_PARSE_BYTES, F.lit("too-large"))
        .when(F.instr(F.substring(text, 1, C.BINARY_CHECK_BYTES), "\0") > 0, F.lit("binary"))
        .when((longest_line(text) > C.MINIFIED_MAX_LINE) | (mean_line(text) > C.MINIFIED_MEAN_LINE), F.lit("minified"))
        .when(~is_supported, F.lit("unsupported-language"))
    )


def identifier_words(name: Column) -> Column:
    """Words of an identifier by underscores, hyphens, camel humps and acronyms, and the whole if it has several."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(spaced, " "), lambda x: x != "")
    return F.when(F.size(words) > 1, F.array_append(words, name)).otherwise(words)


def tokens(text: Column) -> Column:
    """Lower-case index tokens of at least three characters, in text order."""
    raw = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda x: x != "")
    return F.filter(F.transform(F.flatten(F.transform(raw, identifier_words)), F.lower), lambda x: F.length(x) >= C.MIN_TERM)


def query_terms(query: Column) -> Column:
    """struct(terms, dropped): distinct, sorted; terms of fewer than three characters are dropped."""
    raw = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9_]+"), lambda x: x != "")))
    return F.struct(F.filter(raw, lambda x: F.length(x) >= C.MIN_TERM).alias("terms"), F.filter(raw, lambda x: F.length(x) < C.MIN_TERM).alias("dropped"))


def preview(line: Column, terms: list[str]) -> Column:
    """A trimmed line; of a long one the window around the first term that occurs."""
    t, n = F.trim(line), C.PREVIEW_CHARS
    found = [F.instr(F.lower(t), term) for term in terms]
    at = F.coalesce(*(F.when(x > 0, x - 1) for x in found), F.lit(0)) if found else F.lit(0)
    start = F.greatest(F.lit(0), F.least(at - n // 2, F.length(t) - n))
    return F.when(F.length(t) <= n, t).otherwise(F.substring(t, start + 1, F.lit(n)))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for each character, 0 for an empty text. Characters are sorted, so equal ones are neighbours
    and one pass adds up each one's term."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    term = lambda c: (c / n) * F.log2(c / n)
    begin = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.when(a["last"] == x, F.struct(x.alias("last"), (a["c"] + 1).alias("c"), a["s"].alias("s"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("c"), (a["s"] + F.when(a["c"] > 0, term(a["c"])).otherwise(0.0)).alias("s")))
    return F.when(F.size(chars) == 0, F.lit(0.0)).otherwise(F.aggregate(chars, begin, step, lambda a: -(a["s"] + term(a["c"]))))


def char_classes(text: Column) -> Column:
    out = F.lit(0)
    for pattern in ("[a-z]", "[A-Z]", "[0-9]", "(?s)[^A-Za-z0-9]"):
        out = out + text.rlike(pattern).cast("int")
    return out


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("#", path, name, line.cast("string"))), 1, 16)


def valid_text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def truncate(text: Column, lines: int = C.SNIPPET_LINES, size: int = C.SNIPPET_BYTES) -> Column:
    """The first lines, then at most so many bytes without a broken character at the end."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    cut = F.substring(F.encode(head, "UTF-8"), 1, size)
    # A byte cut may leave the first bytes of a character, which become replacement characters.
    whole = F.regexp_replace(valid_text(cut), "�+$", "")
    return F.when(F.octet_length(head) <= size, head).otherwise(whole)


def round_fixed(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def redact_blocks(lines: Column) -> Column:
    """Every line of a private-key block, from its BEGIN line to its END line or the end of the text, is replaced."""
    step = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.struct(
            (F.when(a["inside"], ~x.rlike(C.PEM_END)).otherwise(x.rlike(C.PEM_BEGIN) & ~x.rlike(C.PEM_END))).alias("inside"),
            F.array_append(a["out"], F.when(a["inside"] | x.rlike(C.PEM_BEGIN), F.lit(C.REDACTED)).otherwise(x)).alias("out"),
        ),
    )
    return step["out"]


def _where(line: Column, pattern: str, test, replacement) -> Column:
    """Replaces the matches that pass a test; what lies between matches stays."""

    def put(x: Column) -> Column:
        found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda m: F.when(test(m), replacement(m)).otherwise(m))
        pieces = F.zip_with(F.split(x, pattern, -1), found, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        return F.when(x.rlike(pattern), F.array_join(pieces, "")).otherwise(x)

    return F.transform(F.array(line), put)[0]  # the line is computed once, however often put() names it


def redact_line(line: Column, without: str | None = None) -> Column:
    """All line rules in order; ``without`` leaves one out."""
    for name, pattern, replacement in C.REDACTION_RULES:
        if name == without:
            continue
        if name == "entropy":
            for q in ('"', "'", "`"):
                inner = lambda m: F.substring(m, F.lit(2), F.length(m) - 2)
                secret = lambda m, inner=inner: (char_classes(inner(m)) >= C.ENTROPY_CLASSES) & (entropy(inner(m)) >= C.ENTROPY_BITS)
                line = _where(line, f"{q}[^{q}\\\\]{{{C.ENTROPY_LENGTH},}}{q}", secret, lambda m, q=q: F.lit(f"{q}{C.REDACTED}{q}"))
        elif name == "base64-blob":
            mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
            line = _where(line, f"[A-Za-z0-9+/]{{{C.BASE64_LENGTH},}}={{0,2}}", mixed, lambda m: F.lit(C.REDACTED))
        else:
            line = F.regexp_replace(line, pattern, replacement)
    return line


def redact(text: Column, without: str | None = None) -> Column:
    """A text with its secrets replaced; the number of lines stays."""
    return F.array_join(F.transform(redact_blocks(F.split(text, "\n")), lambda x: redact_line(x, without)), "\n")


def is_excluded_file(path: Column, globs: list[str] | None = None) -> Column:
    from quillstone.functions.paths import basename, ext, glob_regex

    out = ext(path).isin(C.EXCLUDED_EXTENSIONS)
    for pattern in C.EXCLUDED_BASENAMES:
        out = out | basename(path).rlike(pattern)
    for glob in globs or []:
        out = out | path.rlike(glob_regex(glob))
    return out
