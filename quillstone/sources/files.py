"""Scans of file trees, manifests and settings into tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.functions import text as T
from quillstone.sources.tables import keep


def scan_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path (relative), size_bytes, content of every file below root that the ignore rules leave. Content is read only
    where a later step asks for it."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.element_at(F.split("path", base.removeprefix("file:"), 2), -1)
    files = files.select(rel.alias("path"), F.col("length").alias("size_bytes"), "content")
    files = files.where(~P.is_ignored(F.col("path")))
    for glob in exclude or []:
        files = files.where(~F.col("path").rlike(P.ignore_regex(glob)))
    return files


def over_cap(files: DataFrame, most: int = C.MAX_CORPUS_FILES) -> bool:
    """Whether a corpus has more files than a caller allows."""
    return files.select("path").limit(most + 1).count() > most


def read_text(files: DataFrame) -> DataFrame:
    """Adds text (lossy UTF-8), content_hash, line_count, language, skip_reason and is_lossy to scanned files. A file whose
    content is null couldn't be read: it counts as empty, with skip_reason 'unreadable'."""
    content = F.coalesce("content", F.lit(b""))
    out = files.withColumn("text", T.valid_text(content)).withColumn("content_hash", F.sha2(content, 256)).withColumn("language", P.language(F.col("path"))).withColumn("__read", F.col("content").isNotNull())
    reason = T.skip_reason(F.col("size_bytes"), F.col("text"), F.col("language").isin(C.PARSED_LANGUAGES))
    reason = F.when(~F.col("__read"), F.lit("unreadable")).otherwise(reason)
    return out.drop("content").withColumn("line_count", T.n_lines(F.col("text"))).withColumn("skip_reason", reason).drop("__read").withColumn("is_lossy", F.col("text").contains("�"))


def nested_ignores(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that per-directory ignore rules leave. rules: dir, seq, regex (over the path below dir), negated. The deepest
    directory that says anything wins, and in it the last rule."""
    each = files.select("path", F.explode(P.ancestors(F.col("path"))).alias("dir")).join(rules, "dir")
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2))
    said = each.where(F.regexp_like(below, F.col("regex")))
    last = said.groupBy("path").agg(F.max_by("negated", F.struct(F.length("dir"), "seq")).alias("negated"))
    return files.join(last.where("NOT negated"), "path", "left_anti")


def file_slice(files: DataFrame, path: str, size: int, most: int = C.MAX_VIEW_BYTES) -> DataFrame:
    """The first bytes of one file: path, text, is_truncated, line_count; none for a path that leaves the root or a file
    over the limit."""
    one = files.where((F.col("path") == path) & P.is_guarded(F.lit(path)) & (F.col("size_bytes") <= most))
    head = T.valid_text(F.substring("content", 1, size))
    return one.select("path", head.alias("text"), (F.col("size_bytes") > size).alias("is_truncated"), T.n_lines(head).alias("line_count"))


def snippets(files: DataFrame, wanted: DataFrame, lines: int = C.SNIPPET_LINES, size: int = C.SNIPPET_BYTES) -> DataFrame:
    """path and the first lines of each wanted file, after a cut by bytes; a path that isn't there has null content, and
    the caller is to refuse the whole request (missing_answers)."""
    head = F.array_join(F.slice(F.split(T.valid_text(F.substring("content", 1, size)), "\n"), 1, lines), "\n")
    return wanted.join(files.select("path", head.alias("content")), "path", "left")


def missing_answers(answers: DataFrame) -> DataFrame:
    return answers.where("content IS NULL").select("path")


MANIFESTS = {"package.json": "npm", "requirements.txt": "pypi", "pyproject.toml": "pypi", "setup.py": "pypi", "Pipfile": "pypi", "go.mod": "go", "Cargo.toml": "cargo", "pom.xml": "maven", "composer.json": "composer"}


JSON_MANIFESTS = ["package.json", "composer.json"]


def _manifest(files: DataFrame) -> DataFrame:
    """path, kind, text of manifests; a JSON one that is malformed has no text."""
    kind = P.basename(F.col("path"))
    valid = ~kind.isin(JSON_MANIFESTS) | F.try_parse_json("text").isNotNull()
    return files.where(kind.isin(list(MANIFESTS))).select("path", kind.alias("kind"), F.when(valid, F.coalesce("text", F.lit(""))).otherwise(F.lit("")).alias("text"))


def manifests(files: DataFrame) -> DataFrame:
    """path, kind, ecosystem, project_name, version of manifest files (path, text); malformed JSON gives nulls (see
    manifest_failures)."""
    one = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    own = F.regexp_replace("text", r"(?s)<(dependencies|dependencyManagement|parent|build|profiles)>.*?</\1>", "")  # a project's own tags
    tag = lambda name: F.nullif(F.trim(F.regexp_extract(own, f"<{name}>([^<]*)</{name}>", 1)), F.lit(""))
    kind, is_json = F.col("kind"), F.col("kind").isin("package.json", "composer.json")
    quoted = lambda key: one(rf"""(?m)\b{key}\s*=\s*["']([^"']+)["']""")
    name = F.when(is_json, F.get_json_object("text", "$.name")).when(kind == "go.mod", one(r"(?m)^\s*module\s+(\S+)")).when(kind == "pom.xml", tag("artifactId")).when(kind.isin("requirements.txt", "Pipfile"), None).otherwise(quoted("name"))
    version = F.when(is_json, F.get_json_object("text", "$.version")).when(kind == "pom.xml", tag("version")).when(kind.isin("requirements.txt", "Pipfile", "go.mod"), None).otherwise(quoted("version"))
    table = F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv))
    return _manifest(files).select("path", "kind", table[kind].alias("ecosystem"), name.alias("project_name"), version.alias("version"))


def manifest_failures(files: DataFrame) -> DataFrame:
    """severity, code, path of JSON manifests that are no JSON objects."""
    value = F.try_parse_json("text")
    bad = value.isNull() | ~F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    return files.where(P.basename(F.col("path")).isin(JSON_MANIFESTS) & bad).select(F.lit("warning").alias("severity"), F.lit("MANIFEST_INVALID").alias("code"), "path")


REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^#;]*)"


def _requirement(df: DataFrame, line: Column, scope: Column) -> DataFrame:
    each = df.select("path", line.alias("line"), scope.alias("scope")).where(F.col("line").rlike(r"^\s*[A-Za-z0-9]"))
    return each.select("path", F.lit("pypi").alias("ecosystem"), F.lower(F.regexp_extract("line", REQUIREMENT, 1)).alias("name"), F.trim(F.regexp_extract("line", REQUIREMENT, 2)).alias("version_spec"), "scope")


def _table_lines(files: DataFrame, tables: str) -> DataFrame:
    """path, table, key, value of the ``key = value`` lines of TOML tables whose names fit."""
    parts = F.expr(rf"""regexp_extract_all(text, r'(?ms)^\s*\[({tables})\]\s*$(.*?)(?=^\s*\[|\z)', 0)""")
    part = files.select("path", F.explode(parts).alias("part")).select("path", F.regexp_extract("part", r"^\s*\[([^\]]+)\]", 1).alias("table"), F.explode(F.slice(F.split("part", "\n"), 2, 1_000_000)).alias("line"))
    pair = r"""^\s*["']?([A-Za-z0-9._@/-]+)["']?\s*=\s*(.+?)\s*(?:#.*)?$"""
    return part.where(F.col("line").rlike(pair)).select("path", "table", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))


def _spec(value: Column) -> Column:
    """A version out of ``"1.2"`` or ``{ version = "1.2", ... }``."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"""version\s*=\s*["']([^"']*)["']""", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"""^["']([^"']*)["']$""", 1), F.lit("")), F.lit("*"))


def dependencies(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version_spec, scope (runtime, dev, peer, optional, indirect): what manifests (path, text) declare.

    npm and composer by JSON; the others by patterns over their lines, tables or tags: names and
    versions written on one line are read, computed ones are not.
    """
    m = _manifest(files)
    of = lambda *kinds: m.where(F.col("kind").isin(*kinds))
    out: DataFrame | None = None

    def add(part: DataFrame) -> None:
        nonlocal out
        part = part.select("path", "ecosystem", "name", "version_spec", "scope")
        out = part if out is None else out.union(part)

    json_ = [("package.json", "npm", "dependencies", "runtime"), ("package.json", "npm", "devDependencies", "dev"), ("package.json", "npm", "peerDependencies", "peer"), ("package.json", "npm", "optionalDependencies", "optional"), ("composer.json", "composer", "require", "runtime"), ("composer.json", "composer", "require-dev", "dev")]
    for kind, ecosystem, field, scope in json_:
        part = of(kind).select("path", F.explode(F.from_json(F.get_json_object("text", f"$['{field}']"), "map<string,string>")).alias("name", "version_spec"))
        add(part.select("path", F.lit(ecosystem).alias("ecosystem"), "name", "version_spec", F.lit(scope).alias("scope")))
    add(_requirement(of("requirements.txt").select("path", F.explode(F.split("text", "\r?\n")).alias("l")), F.col("l"), F.lit("runtime")))
    strings = lambda body: F.regexp_extract_all(body, F.lit(r"""["']([^"']+)["']"""), F.lit(1))
    listed = lambda key: F.regexp_extract("text", rf"(?s)\b{key}\s*=\s*\[(.*?)\]\s*(?:,|\)|\n|$)", 1)
    add(_requirement(of("setup.py").select("path", F.explode(strings(listed("install_requires"))).alias("l")), F.col("l"), F.lit("runtime")))
    project = F.regexp_extract("text", r"(?ms)^\s*\[project\]\s*$(.*?)(?=^\s*\[[a-z]|\z)", 1)
    own = F.regexp_extract(project, r"(?ms)^\s*dependencies\s*=\s*\[(.*?)^?\s*\]\s*$", 1)
    add(_requirement(of("pyproject.toml").select("path", F.explode(strings(own)).alias("l")), F.col("l"), F.lit("runtime")))
    toml = _table_lines(of("pyproject.toml", "Pipfile", "Cargo.toml"), r"tool\.poetry\.dependencies|tool\.poetry\.dev-dependencies|tool\.poetry\.group\.[\w-]+\.dependencies|packages|dev-packages|dependencies|dev-dependencies|build-dependencies")
    cargo = F.col("path").endswith("Cargo.toml")
    scope = F.when(F.col("table").contains("dev") | F.col("table").contains(".group."), "dev").otherwise("runtime")
    plain = F.col("table").isin("dependencies", "dev-dependencies", "build-dependencies")
    pip = F.col("table").isin("packages", "dev-packages")
    right = F.when(cargo, plain).when(F.col("path").endswith("Pipfile"), pip).otherwise(F.startswith("table", F.lit("tool.")) & (F.col("key") != "python"))
    add(toml.where(right).select("path", F.when(cargo, "cargo").otherwise("pypi").alias("ecosystem"), F.when(cargo, F.col("key")).otherwise(F.lower("key")).alias("name"), _spec(F.col("value")).alias("version_spec"), scope.alias("scope")))
    line = r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./~-]+)\s+(v[\w.+-]+)(\s*//\s*indirect)?"
    required = F.regexp_replace("text", r"(?ms)^\s*(?:replace|exclude|retract)\s*(?:\([^)]*\)|[^\n]*)|^\s*module\s[^\n]*", "")
    go = of("go.mod").select("path", F.explode(F.regexp_extract_all(required, F.lit(line), F.lit(0))).alias("x"))
    add(go.select("path", F.lit("go").alias("ecosystem"), F.regexp_extract("x", line, 1).alias("name"), F.regexp_extract("x", line, 2).alias("version_spec"), F.when(F.col("x").contains("indirect"), "indirect").otherwise("runtime").alias("scope")))
    tags = F.regexp_replace("text", r"(?s)<dependencyManagement>.*?</dependencyManagement>|<!--.*?-->", "")
    pom = of("pom.xml").select("path", F.explode(F.regexp_extract_all(tags, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("x"))
    tag = lambda name: F.trim(F.regexp_extract("x", f"<{name}>([^<]*)</{name}>", 1))
    add(pom.select("path", F.lit("maven").alias("ecosystem"), F.concat(tag("groupId"), F.lit(":"), tag("artifactId")).alias("name"), tag("version").alias("version_spec"), F.when(tag("scope") == "test", "dev").otherwise("runtime").alias("scope")))
    return out


def distinct_dependencies(declared: DataFrame, dirs: DataFrame) -> DataFrame:
    """The first declaration of each (ecosystem, name, scope): by the place of its directory (dirs: dir, place; the root
    first), then by path."""
    placed = declared.withColumn("dir", P.dirname(F.col("path"))).join(dirs, "dir")
    first = placed.groupBy("ecosystem", "name", "scope").agg(F.min_by(F.struct("path", "version_spec"), F.struct("place", "path", "version_spec")).alias("x"))
    return first.select("ecosystem", "name", "scope", "x.version_spec", "x.path")


def workspace_globs(files: DataFrame) -> DataFrame:
    """source, glob: what package.json, pnpm-workspace.yaml and lerna.json at the root (path, text) declare as workspaces."""
    at = lambda name: files.where(F.col("path") == name)
    listed = lambda *paths: F.coalesce(*(F.from_json(F.get_json_object("text", p), "array<string>") for p in paths))
    npm = at("package.json").select(F.lit("package.json").alias("source"), F.explode(listed("$.workspaces", "$.workspaces.packages")).alias("glob"))
    block = F.regexp_extract("text", r"(?ms)^packages\s*:[^\n]*\n((?:[ \t]*-[^\n]*\n?|[ \t]*(?:#[^\n]*)?\n|[ \t]+[^\n]*\n?)*)", 1)
    item = r"""(?m)^\s*-\s*['"]?([^'"#\n]+?)['"]?\s*$"""
    pnpm = at("pnpm-workspace.yaml").select(F.lit("pnpm-workspace.yaml"), F.explode(F.regexp_extract_all(block, F.lit(item), F.lit(1))))
    lerna = at("lerna.json").select(F.lit("lerna.json"), F.explode(listed("$.packages")))
    return npm.union(pnpm).union(lerna).select("source", F.trim("glob").alias("glob"))


def read_settings(text: str | None) -> dict[str, list[str]]:
    """A user's keyword map: {"keywords": {...}} or the map itself; whatever is malformed counts as empty."""
    try:
        value = json.loads(text or "{}")
    except ValueError:
        return {}
    value = value.get("keywords", value) if isinstance(value, dict) else {}
    return {k: [x for x in v if isinstance(x, str)] for k, v in value.items() if isinstance(v, list)} if isinstance(value, dict) else {}


def repo_id(root: Column) -> Column:
    """A corpus's id: the first 16 hex digits of the SHA-256 of its root without closing slashes."""
    return F.substring(F.sha2(F.regexp_replace(root, "/+$", ""), 256), 1, 16)


def strip_json_comments(text: Column) -> Column:
    """JSON without // and /* */ comments and trailing commas; strings stay."""
    kept = F.regexp_replace(text, r'(?s)("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', "$1")
    return F.regexp_replace(kept, r'(?s)("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', "$1")


def tsconfigs(files: DataFrame, deepest: int = 8) -> DataFrame:
    """dir, base, patterns (pattern to targets) of every tsconfig.json and jsconfig.json among configs (path, text).

    Parents by ``extends`` are followed for at most eight steps, one join each; a child's pattern hides its
    parent's of the same name. base is the baseUrl of the config that declares it, or its own directory.
    """
    text = strip_json_comments(F.col("text"))
    here = P.dirname(F.col("path"))
    beside = lambda p: F.array_join(F.aggregate(F.split(F.concat_ws("/", F.nullif(here, F.lit("")), p), "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))), "/")
    up = F.get_json_object(text, "$.extends")
    own = files.select("path", F.when(up.isNotNull(), beside(F.when(up.endswith(".json"), up).otherwise(F.concat(up, F.lit(".json"))))).alias("up"), F.when(F.get_json_object(text, "$.compilerOptions.baseUrl").isNotNull(), beside(F.get_json_object(text, "$.compilerOptions.baseUrl"))).alias("base"), F.from_json(F.get_json_object(text, "$.compilerOptions.paths"), "map<string,array<string>>").alias("paths"))
    own = keep(own)
    step = own.where(P.basename(F.col("path")).isin("tsconfig.json", "jsconfig.json")).select("path", "up", "base", "paths", F.lit(0).alias("depth"))
    every = step
    for depth in range(1, deepest + 1):
        parents = own.select(F.col("path").alias("at"), F.col("up").alias("next"), F.col("base").alias("their_base"), F.col("paths").alias("theirs"))
        step = keep(step.join(parents, F.col("up") == F.col("at")).select("path", F.col("next").alias("up"), F.col("their_base").alias("base"), F.col("theirs").alias("paths"), F.lit(depth).alias("depth")))
        if step.isEmpty():
            break
        every = every.union(step)
    bases = every.groupBy("path").agg(F.min_by("base", F.when(F.col("base").isNotNull(), F.col("depth"))).alias("base"))
    each = every.select("path", "depth", F.explode("paths").alias("pattern", "targets")).groupBy("path", "pattern").agg(F.min_by("targets", "depth").alias("targets"))
    maps = each.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "targets"))).alias("patterns"))
    out = bases.join(maps, "path", "left")
    return out.select(P.dirname(F.col("path")).alias("dir"), F.coalesce("base", P.dirname(F.col("path"))).alias("base"), F.coalesce("patterns", F.create_map().cast("map<string,array<string>>")).alias("patterns"))


def path_patterns(configs: DataFrame) -> DataFrame:
    """dir, pattern, targets of tsconfigs(), as resolve() takes them."""
    return configs.select("dir", F.explode("patterns").alias("pattern", "targets"))


def read_gitignore(files: DataFrame) -> DataFrame:
    """dir, seq, regex, negated of every line of .gitignore files (path, text), as nested_ignores() takes them."""
    lines = files.where(P.basename(F.col("path")) == ".gitignore").select(P.dirname(F.col("path")).alias("dir"), F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))
    lines = lines.where(~F.col("line").rlike(r"^\s*(#|$)")).withColumn("negated", F.startswith("line", F.lit("!")))
    glob = F.regexp_replace(F.rtrim(F.regexp_replace("line", "^!", "")), "/+$", "")
    anchored = F.regexp_replace(glob, "^/", "").contains("/") | glob.startswith("/")
    body = F.regexp_replace(F.regexp_replace(glob, "^/", ""), r"([.+^$(){}|\[\]\\\\])", "\\\\$1")
    for sign, regex in (("\\*\\*/", "\u0001"), ("/\\*\\*$", "\u0002"), ("\\*", "[^/]*"), ("\\?", "[^/]")):
        body = F.regexp_replace(body, sign, regex)
    body = F.replace(F.replace(body, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit("/.*"))
    return lines.select("dir", "seq", F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, F.lit("(?:/.*)?$")).alias("regex"), "negated")
