"""Columns over POSIX paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import constants as C


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def dirname(path: Column) -> Column:
    """'' for a path without a directory."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "^(.*)/[^/]*$", 1)


def ext(path: Column) -> Column:
    """Lower-case extension without its dot; a leading dot starts none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last, '' (the root) first."""
    parts = segments(dirname(path))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normalize(path: Column) -> Column:
    """Backslashes become slashes; leading ./ and / go."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), "^/+", "")


def is_guarded(path: Column) -> Column:
    """True for a relative path without a .. segment."""
    return ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.startswith("/")


def slug(path: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("root")).otherwise(s)


def glob_regex(glob: str) -> str:
    """For a glob whose stars cross slashes: ``*``, ``**`` and ``?`` only."""
    out = ""
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", glob):
        out += ".*" if part[0] == "*" else "." if part == "?" else re.escape(part)
    return f"(?s)^{out}$"


def workspace_regex(glob: str) -> str:
    """For a workspace glob: ``**`` crosses slashes, ``*`` stays within a segment."""
    out = ""
    for part in re.findall(r"\*\*|\*|[^*]+", glob):
        out += {"**": ".*", "*": "[^/]+"}.get(part, re.escape(part))
    return f"^{out}$"


def ignore_regex(glob: str) -> str:
    """For a pattern of an ignore list: without a slash it matches the basename at any depth."""
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob.strip("/")))
    return f"^{'' if '/' in glob.strip('/') and not glob.startswith('**/') else '(?:.*/)?'}{body}(?:/.*)?$"


def is_ignored(path: Column, dirs: list[str] = C.IGNORED_DIRS, globs: list[str] = C.IGNORED_GLOBS) -> Column:
    names = F.array(*(F.lit(d) for d in dirs))
    return F.arrays_overlap(F.split(path, "/"), names) | path.rlike("|".join(ignore_regex(g) for g in globs))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in C.LANGUAGE_BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ext(path)), F.lit("other"))


def has_generated_mark(path: Column, header: Column) -> Column:
    """A marker within the first three lines, or in the basename."""
    lines = F.array_join(F.slice(F.split(F.coalesce(header, F.lit("")), "\n"), 1, 3), "\n")
    found = [F.contains(lines, F.lit(m)) for m in C.GENERATED_MARKERS] + [F.contains(F.lower(basename(path)), F.lit(m)) for m in C.GENERATED_INFIXES]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def classify(path: Column, header: Column, is_entry: Column) -> Column:
    """The first of 18 ordered classes that fits."""
    base, lower, e = basename(path), F.lower(basename(path)), ext(path)
    dirs = F.transform(segments(dirname(path)), F.lower)
    within = lambda names: F.arrays_overlap(dirs, F.array(*(F.lit(n) for n in names)))
    test = F.exists(dirs, lambda d: d.rlike(C.TEST_SEGMENT))
    for pattern in C.TEST_BASENAMES:
        test = test | base.rlike(pattern)
    out = F.when(is_entry, F.lit("entrypoint")).when(test, F.lit("test")).when(within(C.FIXTURE_SEGMENTS), F.lit("fixture"))
    out = out.when(e.isin(C.STYLE_EXTENSIONS), F.lit("style")).when(e.isin(C.DOCS_EXTENSIONS) | within(["docs"]), F.lit("docs"))
    out = out.when(lower.isin(C.CONFIG_FILENAMES) | e.isin(C.CONFIG_EXTENSIONS) | within(["config"]), F.lit("config"))
    out = out.when(has_generated_mark(path, header), F.lit("generated"))
    extra = {"component": base.rlike(C.COMPONENT_BASENAME), "hook": base.rlike(C.HOOK_BASENAME)}
    for name, names in C.SEGMENT_CLASSES:
        out = out.when(within(names) | extra[name] if name in extra else within(names), F.lit(name))
    return out.when(e.isin(C.ASSET_EXTENSIONS), F.lit("asset")).otherwise(F.lit("unknown"))
