"""Symbols and imports of source files as rows.

Python goes through the standard ``ast``; a statement that it can't read is left out, with a warning for the file. JavaScript
and TypeScript are scanned as whole texts: comments and the insides of strings are blanked, brackets are
matched, and declarations are found by their keywords. That is an approximation without a grammar: object
methods and declarations after the first of a list are not seen.
Parsers run file by file in Arrow tasks; everything after them is joins and filters over their rows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL_TYPES = {"path": pa.string(), "name": pa.string(), "kind": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "is_exported": pa.bool_(), "container_name": pa.string()}
IMPORT_TYPES = {"path": pa.string(), "specifier": pa.string(), "line": pa.int32(), "kind": pa.string(), "is_type_only": pa.bool_(), "is_literal": pa.bool_()}
FAILURE_TYPES = {"path": pa.string(), "severity": pa.string(), "code": pa.string()}
#: Statements of a Python file that may be left out before the file counts as unreadable.
MOST_REPAIRS = 25
#: Attributes by which decorators and calls register routes.
PYTHON_ROUTES = {"route", "get", "post", "put", "delete", "patch", "options", "head", "websocket"}
SCRIPT_ROUTES = "get|post|put|delete|patch|options|head|use"


def _each(files: DataFrame, types: dict[str, pa.DataType], rows: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """The rows that each file (path, text) gives."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(path, *row) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in rows(path or "", text or "")]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    spark_types = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
    return files.select("path", "text").mapInArrow(parse, ", ".join(f"{k} {spark_types[v]}" for k, v in types.items()))


# --- Python -----------------------------------------------------------------------------------------------------------
def python_tree(text: str) -> tuple[ast.Module | None, bool]:
    """The tree of a file and whether all of it was read: lines that stop the parser are blanked one by one."""
    lines = text.split("\n")
    for i in range(MOST_REPAIRS + 1):
        try:
            return ast.parse("\n".join(lines)), i == 0
        except SyntaxError as e:
            at = (e.lineno or 0) - 1
            if not 0 <= at < len(lines) or re.fullmatch(r"\s*pass", lines[at]):
                break
            lines[at] = re.match(r"\s*", lines[at])[0] + "pass"
        except (ValueError, RecursionError, MemoryError):
            break
    return None, False


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _python_symbols(tree: ast.Module) -> Iterator[tuple]:
    todo: list[tuple[ast.AST, str | None, bool]] = [(node, None, False) for node in tree.body]
    for node in tree.body:
        if isinstance(node, ast.Assign | ast.AnnAssign):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name):
                kind = "const" if re.fullmatch("[A-Z][A-Z0-9_]*", target.id) else "variable"
                yield target.id, kind, node.lineno, node.end_lineno, not target.id.startswith("_"), None
    while todo:
        node, container, in_class = todo.pop()
        inner = container
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            yield node.name, "class" if is_class else "method" if in_class else "function", _first_line(node), node.end_lineno, not node.name.startswith("_"), container
            for call in node.decorator_list if not is_class else []:
                at = call.args[0] if isinstance(call, ast.Call) and call.args else None
                if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name) and call.func.attr in PYTHON_ROUTES and isinstance(at, ast.Constant) and isinstance(at.value, str) and at.value.startswith("/"):
                    yield at.value, "route", call.lineno, call.end_lineno, False, container
            inner = node.name
            todo += [(child, inner, is_class) for child in node.body]
        else:
            todo += [(child, inner, False) for child in ast.iter_child_nodes(node) if isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case)]


def _python_imports(tree: ast.Module) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for name in node.names:
                yield name.name, node.lineno, "static", False, True
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for name in node.names:
                yield base if name.name == "*" else base + ("" if base.endswith(".") or not base else ".") + name.name, node.lineno, "static", False, True
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "import_module" and isinstance(node.func.value, ast.Name) and node.func.value.id == "importlib" and node.args:
            literal = isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str)
            yield node.args[0].value if literal else ast.unparse(node.args[0]), node.lineno, "dynamic", False, literal


def _python(rows: Callable[[ast.Module], Iterator[tuple]], order: Callable[[tuple], tuple]) -> Callable[[str, str], Iterator[tuple]]:
    def each(_: str, text: str) -> Iterator[tuple]:
        tree, _whole = python_tree(text)
        yield from sorted(rows(tree), key=order) if tree else ()

    return each


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, methods, classes, module-level assignments and decorator routes of Python files (path, text), by line."""
    return _each(files, SYMBOL_TYPES, _python(_python_symbols, lambda r: (r[2], r[0])))


def python_imports(files: DataFrame) -> DataFrame:
    """Imports of Python files, one for each name of a ``from`` import."""
    return _each(files, IMPORT_TYPES, _python(_python_imports, lambda r: (r[1], r[0])))


def module_guards(files: DataFrame) -> DataFrame:
    """Files that run as scripts."""
    return files.where(F.col("text").rlike(r"""if\s+__name__\s*==\s*['"]__main__['"]\s*:""")).select("path")


# --- JavaScript and TypeScript ----------------------------------------------------------------------------------------
_SKIPPED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|$)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*(?:`|$)|(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*""", re.S)
_Q = r"""(?P<q>["'])(?P<s>[^"'\n]*)(?P=q)"""
_IMPORTS = [
    ("static", re.compile(rf"(?<![.\w$])import\b(?P<clause>[^;\"'`()]*?)\bfrom\s*{_Q}")),
    ("static", re.compile(rf"(?<![.\w$])import\s*(?P<clause>){_Q}")),
    ("reexport", re.compile(rf"(?<![.\w$])export\b(?P<clause>\s*(?:type\b\s*)?(?:\*(?:\s*as\s+[\w$]+)?|\{{[^}}]*\}}))\s*from\s*{_Q}")),
    ("require", re.compile(rf"(?<![.\w$])require\s*\(\s*(?P<clause>){_Q}\s*\)")),
    ("dynamic", re.compile(rf"(?<![.\w$])import\s*\(\s*(?P<clause>){_Q}")),
]
_TYPE_ONLY = re.compile(r"\s*type\b(?!\s*(?:,|from\b|$))")
_NAME = r"[A-Za-z_$][\w$]*"
_HEAD = r"(?<![.\w$])(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?"
_FUNCTION = re.compile(rf"{_HEAD}(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^(]*>)?\s*\(")
_CLASS = re.compile(rf"{_HEAD}(?:abstract\s+)?class\s+(?P<name>{_NAME})")
_TYPES = re.compile(rf"{_HEAD}(?:(?P<interface>interface)\s+|(?P<enum>(?:const\s+)?enum)\s+|(?P<type>type)\s+)(?P<name>{_NAME})\s*(?:<[^={{]*>\s*)?(?=[={{]|extends\b)")
_VARIABLE = re.compile(rf"{_HEAD}(?P<word>const|let|var)\s+(?!enum\b)(?P<name>{_NAME})\b(?P<typed>[^=;\n]*)(?P<value>=(?![=>])\s*(?:async\b\s*)?(?P<callable>function\b|(?:<[^(]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+)?=>|{_NAME}\s*=>)?)?")
_METHOD = re.compile(rf"(?<![.\w$])(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*(?P<name>#?{_NAME})\s*(?:<[^(]*>)?\s*\(")
_ROUTE = re.compile(rf"""(?<![.\w$]){_NAME}\.(?:{SCRIPT_ROUTES})\s*\(\s*{_Q}\s*,""")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "new", "typeof", "await", "import", "require"}


class Script:
    """A JavaScript or TypeScript text with comments and insides of strings blanked, brackets matched and lines counted."""

    def __init__(self, path: str, text: str):
        self.text = text
        self.whole = True

        def blank(m: re.Match) -> str:
            s = m[0]
            quoted = s[0] in "\"'`"
            self.whole &= not (s.startswith("/*") and not s.endswith("*/") or s[0] == "`" and (len(s) < 2 or s[-1] != "`"))
            inner = re.sub(r"[^\n]", " ", s)
            return s[0] + inner[1:-1] + s[-1] if quoted and len(s) > 1 and s[-1] == s[0] else inner

        self.code = _SKIPPED.sub(blank, text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.close: dict[int, int] = {}
        opened: list[int] = []
        self.curly: list[tuple[int, int]] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            at, c = m.start(), m[0]
            if c in "([{":
                opened.append(at)
            elif opened and self.code[opened[-1]] + c in ("()", "[]", "{}"):
                self.close[opened.pop()] = at
            else:
                self.whole = False
        self.whole &= not opened
        self.curly = sorted((a, b) for a, b in self.close.items() if self.code[a] == "{")
        self.jsx = path.endswith((".tsx", ".jsx", ".js", ".mjs", ".cjs"))

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def body(self, at: int, stop: str = ";") -> int:
        """The bracket that closes the first block after a place, or where a statement without one ends."""
        i = at
        while i < len(self.code):
            c = self.code[i]
            if c == "{":
                return self.close.get(i, len(self.code) - 1)
            if c in stop:
                return i
            i = self.close.get(i, i) + 1
        return max(len(self.code) - 1, 0)

    def statement(self, at: int) -> int:
        """Where a statement ends: a semicolon outside brackets, or the end of a line that can't go on."""
        i = last = at
        while i < len(self.code):
            c = self.code[i]
            if c == ";" or c in ")]}":
                return i if c == ";" else last
            if c == "\n" and self.code[last] not in "=,+-*/&|?:<(.[{>" and not re.match(r"\s*[.?:&|+*/)=]", self.code[i + 1 :][:80]):
                return last
            if not c.isspace():
                last = i = self.close.get(i, i)
            i += 1
        return last

    def imports(self) -> Iterator[tuple]:
        for kind, pattern in _IMPORTS:
            for m in pattern.finditer(self.code):
                specifier = self.text[m.start("s") : m.end("s")]
                typed = kind in ("static", "reexport") and bool(_TYPE_ONLY.match(m["clause"]))
                yield specifier, self.line(m.start()), "type" if typed and kind == "static" else kind, typed, True

    def symbols(self) -> Iterator[tuple]:
        depth = 0
        edges = sorted([(a, 1) for a, _ in self.curly] + [(b, -1) for _, b in self.curly])
        where, depths = [], []
        for at, d in edges:
            depth += d
            where.append(at)
            depths.append(depth)
        def level(at: int) -> int:
            i = bisect_right(where, at) - 1
            return depths[i] if i >= 0 else 0

        def declared(at: int) -> bool:
            before = self.code[:at].rstrip()[-1:] if at else ""
            return before not in tuple("=(,:[?&|!") and not re.search(r"(?:return|=>|new|typeof)\s*$", self.code[max(0, at - 40) : at])

        found: list[tuple[int, int, str, str, bool]] = []  # start, end, name, kind, exported
        holders: list[tuple[int, int, str]] = []
        for m in _FUNCTION.finditer(self.code):
            if declared(m.start()):
                end = self.body(self.close.get(m.end() - 1, m.end()) + 1, ";\n")
                if self.code[end : end + 1] != "}":
                    continue  # a signature without a body
                found.append((m.start(), end, m["name"], "function", bool(m["export"])))
                holders.append((m.start(), end, m["name"]))
        for m in _CLASS.finditer(self.code):
            if declared(m.start()):
                end = self.body(m.end())
                found.append((m.start(), end, m["name"], "class", bool(m["export"])))
                holders.append((m.start(), end, m["name"]))
                first = self.code.find("{", m.end())
                inside = level(first) if first >= 0 else -1
                for x in _METHOD.finditer(self.code, first + 1, end):
                    if level(x.start()) == inside and x["name"] not in _NOT_METHODS:
                        after = self.close.get(x.end() - 1)
                        if after is not None and re.match(r"\s*(?::[^;{=]*)?\{", self.code[after + 1 : end]):
                            to = self.body(after + 1)
                            found.append((x.start("name") - len(x[0][: x.start("name") - x.start()].lstrip()), to, x["name"], "method", False))
                            holders.append((x.start("name"), to, x["name"]))
        for m in _TYPES.finditer(self.code):
            kind = "interface" if m["interface"] else "enum" if m["enum"] else "type"
            end = self.statement(m.end()) if kind == "type" else self.body(m.end())
            found.append((m.start(), end, m["name"], kind, bool(m["export"])))
            if kind == "interface":
                holders.append((m.start(), end, m["name"]))
        for m in _VARIABLE.finditer(self.code):
            if level(m.start()) == 0:
                kind = "const" if m["word"] == "const" else "variable"
                found.append((m.start(), self.statement(m.end("name") - 1), m["name"], f"{kind}()" if m["callable"] else kind, bool(m["export"])))
        for m in _ROUTE.finditer(self.code):
            call = self.code.index("(", m.start())
            found.append((m.start(), self.close.get(call, m.end()), self.text[m.start("s") : m.end("s")], "route", False))
        for start, end, name, kind, exported in found:
            plain = kind.removesuffix("()")
            if plain == "route" or plain in ("const", "variable") and plain == kind:
                named = plain
            else:
                named = "hook" if re.match("use[A-Z]", name) else "component" if self.jsx and re.fullmatch("[A-Z][A-Za-z0-9]*", name) else plain
            around = [(b - a, n) for a, b, n in holders if a < start and end <= b]
            begin = start + len(self.code[start:end]) - len(self.code[start:end].lstrip())
            yield name, named, self.line(begin), self.line(end), exported, min(around)[1] if around else None


def script_imports(files: DataFrame) -> DataFrame:
    """Imports of JavaScript and TypeScript files (path, text), over as many lines as they have: static, type, reexport,
    require, dynamic. What stands in comments or strings is none."""
    return _each(files, IMPORT_TYPES, lambda path, text: iter(sorted(Script(path, text).imports(), key=lambda r: (r[1], r[0]))))


def script_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes, methods, interfaces, types, enums, top-level variables and routes of JavaScript and TypeScript
    files; callables and types named like hooks and components are these."""
    return _each(files, SYMBOL_TYPES, lambda path, text: iter(sorted(Script(path, text).symbols(), key=lambda r: (r[2], r[0]))))


# --- diagnostics ------------------------------------------------------------------------------------------------------
def parse_failures(files: DataFrame) -> DataFrame:
    """Diagnostics of files that are read in part (warning) or not at all (error): path, severity, code."""

    def judge(path: str, text: str) -> Iterator[tuple]:
        if path.endswith((".py", ".pyi")):
            tree, whole = python_tree(text)
            if not whole:
                yield "error" if tree is None else "warning", "PARSE_FAILED"
        elif path.endswith((".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")) and not Script(path, text).whole:
            yield "warning", "PARSE_FAILED"

    return _each(files, FAILURE_TYPES, judge)


def require_some_parsed(files: DataFrame, failures: DataFrame) -> None:
    """Raises if there are files and every one of them failed; one aggregate, not a loop."""
    bad = failures.where("severity = 'error'").select("path").distinct()
    row = files.select("path").distinct().join(bad.withColumn("bad", F.lit(True)), "path", "left").agg(F.count("*").alias("n"), F.count("bad").alias("bad")).first()
    if row["n"] and row["n"] == row["bad"]:
        raise RuntimeError(f"none of {row['n']} files could be parsed")
