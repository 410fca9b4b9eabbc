"""Directory roll-ups, modules, dependencies and counters over a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.functions import text as T


def language_stats(files: DataFrame) -> DataFrame:
    """language, file_count, line_count, share_percent (of files, one decimal)."""
    g = files.groupBy("language").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("line_count"))
    return g.withColumn("share_percent", F.round(100.0 * F.col("file_count") / F.sum("file_count").over(Window.partitionBy()), 1))


def directory_rollup(files: DataFrame) -> DataFrame:
    """path, file_count (directly in it), descendant_file_count (at any depth) of every directory."""
    each = files.select(F.col("path").alias("file"), F.explode(P.ancestors(F.col("path"))).alias("path"))
    return each.groupBy("path").agg(F.sum((P.dirname(F.col("file")) == F.col("path")).cast("long")).alias("file_count"), F.count("*").alias("descendant_file_count"))


def dominant(files: DataFrame, key: str, value: str) -> DataFrame:
    """key and the most frequent value of each, ties to the smaller value."""
    g = files.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return g.withColumn("k", F.row_number().over(w)).where("k = 1").select(key, F.col(value).alias("dominant"), "n")


def module_candidates(files: DataFrame, roots: list[str]) -> DataFrame:
    """file path and each directory one or two levels below a source root that holds it."""
    under = []
    for root in roots:
        inner = F.when(F.lit(root == "") | F.startswith("path", F.lit(f"{root}/")), P.segments(F.substr(P.dirname(F.col("path")), F.lit(len(root) + 2 if root else 1))))
        under += [F.when(F.size(inner) >= d, F.concat_ws("/", F.lit(root) if root else F.lit(None).cast("string"), F.array_join(F.slice(inner, 1, d), "/"))) for d in (1, 2)]
    return files.select("path", F.explode(F.array_distinct(F.filter(F.array(*under), lambda x: x.isNotNull()))).alias("dir"))


def modules(files: DataFrame, roots: list[str], least: int = C.MODULE_MIN_FILES, most: int = C.MAX_MODULES) -> tuple[DataFrame, DataFrame]:
    """(path, module) of every file, null without one, and (module, file_count).

    A directory qualifies with enough parsed files directly in it; a file belongs to the deepest
    qualifying candidate; the largest modules stay, files of the others go to 'other'.
    """
    candidates = module_candidates(files, roots)
    direct = files.where("is_parsed").groupBy(P.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = candidates.join(direct.select("dir"), "dir", "left_semi").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    counts = own.groupBy("dir").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "dir").limit(most).select("dir", F.col("dir").alias("top"))
    named = own.join(F.broadcast(top), "dir", "left").select("path", F.coalesce("top", F.lit("other")).alias("module"))  # at most `most` rows
    out = files.select("path").join(named, "path", "left")
    return out, out.where("module IS NOT NULL").groupBy("module").agg(F.count("*").alias("file_count"))


def module_edges(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Different pairs of modules with an edge between their files; edges: from_path, to_path."""
    a = assigned.where("module IS NOT NULL")
    e = edges.join(a.selectExpr("path AS from_path", "module AS from_module"), "from_path").join(a.selectExpr("path AS to_path", "module AS to_module"), "to_path")
    return e.where("from_module <> to_module").select("from_module", "to_module").distinct()


def top_files_by_group(files: DataFrame, group: str, order: list, most: int = 5) -> DataFrame:
    """The first files of each group, as group, rank, path."""
    w = Window.partitionBy(group).orderBy(*order)
    return files.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select(group, "rank", "path")


def external_importers(imports: DataFrame) -> DataFrame:
    """ecosystem, package, importers (sorted, distinct paths), n_importers. Pairs are made distinct before they are gathered,
    so a package's row holds each path once."""
    pairs = imports.select("ecosystem", "package", "path").distinct()
    return pairs.groupBy("ecosystem", "package").agg(F.array_sort(F.collect_list("path")).alias("importers"), F.count("*").alias("n_importers"))


def dependency_usage(declared: DataFrame, imports: DataFrame) -> DataFrame:
    """declared (ecosystem, name) with the number of different files that import it and the package's role."""
    used = imports.select("ecosystem", F.col("package").alias("name"), "path").distinct().groupBy("ecosystem", "name").agg(F.count("*").alias("n"))
    roles = F.create_map(*(F.lit(x) for kv in C.DEPENDENCY_ROLES.items() for x in kv))
    out = declared.join(used, ["ecosystem", "name"], "left")
    return out.select(*declared.columns, F.coalesce("n", F.lit(0)).alias("imported_by_count"), F.try_element_at(roles, F.col("name")).alias("role"))


def nearest_ancestor(files: DataFrame, configs: DataFrame) -> DataFrame:
    """path and the config of its nearest enclosing directory; configs: dir, config. An equality join on every ancestor,
    so no prefix is compared with every file."""
    each = files.select("path", F.explode(P.ancestors(F.col("path"))).alias("dir"))
    return each.join(configs, "dir").groupBy("path").agg(F.max_by("config", F.length("dir")).alias("config"))


def probe(imports: DataFrame, existing: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """import_id and the first existing of its candidate paths (base plus each suffix in order); null where none exists."""
    suffixes = suffixes or [*C.PROBE_SUFFIXES, *C.INDEX_SUFFIXES]
    each = imports.select("import_id", F.posexplode(F.transform(F.array(*(F.lit(s) for s in suffixes)), lambda s: F.concat("base", s))).alias("pos", "path"))
    found = each.join(existing.select("path").distinct(), "path").groupBy("import_id").agg(F.min_by("path", "pos").alias("to_path"))
    return imports.select("import_id", "base").join(found, "import_id", "left")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order that is total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def workspace_shares(files: DataFrame) -> DataFrame:
    """Top directories that look like workspaces: at least a fifth of the largest, two or more, together half of all files."""
    g = files.groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()  # a row for each top directory
    g = g.select("dir", "n", F.max("n").over(all_).alias("largest"), F.sum("n").over(all_).alias("total"))
    g = g.where("n * 5 >= largest").select("dir", "n", "total", F.sum("n").over(all_).alias("kept"), F.count("*").over(all_).alias("survivors"))
    return g.where("survivors >= 2 AND kept * 2 >= total").select("dir", "n")


def delete_cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parent still exists."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def reconcile(live: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key and change (add, remove): what turns the live set into the target set."""
    l, t = live.select(key).distinct().withColumn("__live", F.lit(True)), target.select(key).distinct().withColumn("__wanted", F.lit(True))
    both = l.join(t, key, "full")
    return both.where("__live IS NULL OR __wanted IS NULL").select(key, F.when(F.col("__live").isNull(), "add").otherwise("remove").alias("change"))


def consecutive(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """rows with next and previous: the value of the neighbouring rows of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("next", F.lead(value).over(w)).withColumn("previous", F.lag(value).over(w))


def min_max(rows: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """rows with scaled: value between the least (0) and the largest (1); 0 where all are equal."""
    ends = rows.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    scaled = F.coalesce((F.col(value) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0)), F.lit(0.0))
    return rows.crossJoin(F.broadcast(ends)).withColumn("scaled", F.round(scaled, digits)).drop("__low", "__high")  # one row


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, unresolved: DataFrame, diagnostics: DataFrame, entries: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of counters. files: path, language, line_count, size_bytes, is_parsed; parts: component of each file."""
    f = files.agg(F.count("*").alias("n_files"), F.expr("count_if(is_parsed)").alias("n_parsed"), F.expr("count_if(NOT is_parsed)").alias("n_skipped"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.countDistinct("language").alias("n_languages"))
    out = f
    for name, df in (("n_symbols", symbols), ("n_edges", edges), ("n_unresolved", unresolved), ("n_diagnostics", diagnostics), ("n_entry_points", entries)):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return out.crossJoin(parts.agg(F.countDistinct("component").alias("n_components")))


def depth_budget(dirs: DataFrame, most: int = 60) -> DataFrame:
    """depth: the deepest level at which no more than ``most`` directories (dir) show, at least 1."""
    n = dirs.where("dir <> ''").groupBy(F.size(F.split("dir", "/")).alias("depth")).agg(F.countDistinct("dir").alias("n"))
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # a row for each depth
    total = n.withColumn("shown", F.sum("n").over(w))
    return total.agg(F.greatest(F.coalesce(F.max(F.when(F.col("shown") <= most, F.col("depth"))), F.lit(1)), F.lit(1)).cast("long").alias("depth"))


def union_diagnostics(*sources: DataFrame) -> DataFrame:
    """severity, code, path of all sources: the scan's, reading's, manifests' and the parsers'."""
    out = sources[0].select("severity", "code", "path")
    for s in sources[1:]:
        out = out.unionByName(s.select("severity", "code", "path"))
    return out


def text_diagnostics(files: DataFrame) -> DataFrame:
    """severity, code, path for texts (path, text) that reading had to repair, or whose lines are too long to be parsed."""
    each = F.array(
        F.when(F.col("text").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("FILE_UNREADABLE").alias("code"))),
        F.when(F.contains("text", F.lit("\ufffd")), F.struct(F.lit("warning").alias("severity"), F.lit("ENCODING_LOSSY").alias("code"))),
        F.when(T.longest_line(F.col("text")) > C.MINIFIED_MAX_LINE, F.struct(F.lit("info").alias("severity"), F.lit("MINIFIED").alias("code"))),
    )
    return files.select("path", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.severity", "x.code", "path")


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON with sorted keys at every depth, nulls written, no white space; numbers that JSON lacks raise."""

    def ordered(c: Column, t: T_.DataType) -> Column:
        if isinstance(t, T_.StructType):
            inner = F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name.encode())))
            return F.when(c.isNotNull(), inner)
        if isinstance(t, T_.ArrayType):
            return F.transform(c, lambda x: ordered(x, t.elementType))
        if isinstance(t, T_.MapType):
            pairs = F.array_sort(F.map_entries(c))
            return F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["key"], ordered(x["value"], t.valueType))))
        if isinstance(t, T_.FloatType | T_.DoubleType):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("no JSON number")).cast(t)).otherwise(c)
        return c

    names = sorted(columns or df.columns, key=str.encode)
    return F.to_json(F.struct(*(ordered(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names)), {"ignoreNullFields": "false"})


def changed(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose (path, content_hash) the cache lacks."""
    return current.join(cached.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def hits(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose (path, content_hash) the cache has, whose parse results can be reused."""
    return current.join(cached.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def vanished(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached paths that no longer exist."""
    return cached.join(current.select("path"), "path", "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows of the same key replaced by the new ones."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def document_fingerprint(df: DataFrame) -> DataFrame:
    """df with fingerprint: the SHA-256 of each row's canonical JSON in which its own fingerprint is empty, whatever df had
    there."""
    empty = df.withColumn("fingerprint", F.lit(""))
    return empty.withColumn("fingerprint", F.sha2(canonical_json(empty), 256))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies a table's rows whatever their order: n_rows, and the SHA-256 of the number and the sum of the
    rows' own digests (the first 60 bits of the SHA-256 of their canonical JSON). Sums combine before the shuffle."""
    h = F.conv(F.substring(F.sha2(canonical_json(df), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("__sum"))
    return one.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), "__sum"), 256).alias("fingerprint"))
