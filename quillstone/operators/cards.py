"""What describes a whole corpus: its kind, source roots, entry points, module cards and reasons of reading steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.operators.graph import rank_rows
from quillstone.operators.structure import module_edges, modules, top_files_by_group

#: Files that are entry points by convention, in order, and suffixes tried on a manifest's path.
CONVENTIONS = ["src/index.ts", "src/index.js", "index.ts", "index.js"]
MANIFEST_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
WEB_FRAMEWORKS = ["flask", "django", "fastapi"]
PYTHON_MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile"]


def detected_type(manifests: DataFrame, dependencies: DataFrame, workspaces: DataFrame, by: str = "repo") -> DataFrame:
    """``by`` and the label of each corpus. manifests: by, kind; dependencies: by, name; workspaces: by, dir.

    Several workspaces make a monorepo; then npm manifests decide by framework, then Python ones.
    Grouped conditional aggregates, so a corpus may have any number of manifests.
    """
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    kinds = manifests.groupBy(by).agg(any_(F.col("kind") == "package.json").alias("npm"), any_(F.col("kind").isin(PYTHON_MANIFESTS)).alias("py"))
    names = dependencies.groupBy(by).agg(any_(F.col("name") == "next").alias("next"), any_(F.col("name").isin("react", "react-dom")).alias("react"), any_(F.col("name") == "vue").alias("vue"), any_(F.col("name").isin(WEB_FRAMEWORKS)).alias("web"))
    spaces = workspaces.groupBy(by).agg(F.countDistinct("dir").alias("n_spaces"))
    all_ = manifests.select(by).union(dependencies.select(by)).union(workspaces.select(by)).distinct()
    out = all_.join(kinds, by, "left").join(names, by, "left").join(spaces, by, "left")
    label = (
        F.when(F.col("n_spaces") > 1, F.concat(F.lit("Monorepo ("), F.col("n_spaces"), F.lit(" workspaces)")))
        .when(F.col("npm"), F.when(F.col("next"), "Next.js application").when(F.col("react"), "React application").when(F.col("vue"), "Vue application").otherwise("Node.js service"))
        .when(F.col("py"), F.when(F.col("web"), "Python web application").otherwise("Python package"))
        .otherwise("Unknown project type")
    )
    return out.select(by, label.alias("label"))


def source_roots(workspaces: DataFrame) -> list[str]:
    """Workspace directories, sorted, or the root. A corpus declares its workspaces, so there are few."""
    return [r["dir"] for r in workspaces.select("dir").distinct().orderBy("dir").collect()] or [""]


def entry_points(files: DataFrame, dirs: DataFrame, manifests: DataFrame, guards: DataFrame) -> DataFrame:
    """path, evidence, kind, priority, rank of entry points, ranked over all by (priority, path).

    files: path; dirs: the root and every workspace (dir); manifests: dir, main, bin (map), start of
    package.json files; guards: path of Python files that run as scripts. A path counts once, by
    the first rule that names it in the order of the directories: manifest main, bin and start
    script, conventional names, then ``__main__.py`` and module guards.
    """
    here = files.select("path").distinct()
    join_dir = lambda p: F.concat_ws("/", F.nullif("dir", F.lit("")), F.regexp_replace(p, r"^\./", ""))
    m = manifests.join(dirs.select("dir").distinct(), "dir")
    start = F.regexp_extract("start", r"([./\w-]+\.[cm]?[tj]sx?)\b", 1)
    named = [
        m.where("main IS NOT NULL").select("dir", F.lit(0).alias("rule"), join_dir(F.col("main")).alias("base"), F.lit("package.json#main").alias("evidence"), F.lit("main").alias("kind"), F.lit(0).alias("priority")),
        m.select("dir", F.explode("bin").alias("name", "to")).select("dir", F.lit(1), join_dir(F.col("to")), F.when(F.col("name") == "", "package.json#bin").otherwise(F.concat(F.lit("package.json#bin."), F.col("name"))), F.lit("bin"), F.lit(1)),
        m.where(start != "").select("dir", F.lit(2), join_dir(start), F.lit("package.json#scripts.start"), F.lit("script"), F.lit(4)),
    ]
    bases = named[0].union(named[1]).union(named[2])
    suffixes = F.posexplode(F.array(*(F.lit(s) for s in MANIFEST_SUFFIXES))).alias("pos", "suffix")
    tried = bases.select("*", suffixes).withColumn("path", F.concat("base", "suffix")).join(here, "path")
    chosen = tried.groupBy("dir", "rule", "base", "evidence", "kind", "priority").agg(F.min_by("path", "pos").alias("path")).select("dir", "rule", "path", "evidence", "kind", "priority")
    names = F.posexplode(F.array(*(F.lit(s) for s in CONVENTIONS))).alias("pos", "name")
    usual = dirs.select("dir", names).withColumn("path", join_dir(F.col("name"))).join(here, "path").groupBy("dir").agg(F.min_by(F.struct("path", "name"), "pos").alias("x"))
    usual = usual.select("dir", F.lit(3), "x.path", F.concat(F.lit("convention:"), F.col("x.name")), F.lit("convention"), F.lit(3))
    last = F.lit("￿")  # after every directory
    is_main = F.col("path").rlike(r"(^|/)__main__\.py$")
    mains = here.where(is_main).select(last, F.lit(4), "path", F.lit("python:__main__.py"), F.lit("main"), F.lit(2))
    scripts = guards.select("path").distinct().where(~is_main).select(last, F.lit(5), "path", F.lit("python:module-guard"), F.lit("script"), F.lit(5))
    every = chosen.union(usual).union(mains).union(scripts)
    first = every.groupBy("path").agg(F.min_by(F.struct("evidence", "kind", "priority"), F.struct("dir", "rule", "evidence")).alias("x")).select("path", "x.*")
    return rank_rows(first, ["priority", "path"])


def likely_entry_points(files: DataFrame) -> DataFrame:
    """path, priority, rank: entry points guessed from file names alone, where a corpus has no manifests."""
    base = F.lower(P.stem(F.col("path")))
    kind = F.when(base == "main", 1).when(base == "index", 2).when(base.isin("app", "server"), 3).when(base == "cli", 4)
    return rank_rows(files.select("path", kind.alias("priority")).where("priority IS NOT NULL"), ["priority", "path"])


def purpose(dir_: Column, n_files: Column) -> Column:
    """A sentence on what a directory is for, by its name."""
    table = F.create_map(*(F.lit(x) for pair in C.MODULE_PURPOSES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(P.basename(dir_))), F.concat(n_files.cast("string"), F.lit(" files; no directory convention matched.")))


def module_cards(files: DataFrame, roots: list[str], edges: DataFrame, least: int = C.MODULE_MIN_FILES, most: int = C.MAX_MODULES) -> DataFrame:
    """dir, id, name, purpose, file_count, key_files, depends_on, depended_on_by of every module; there are ``most`` + 1 at most.

    files: path, is_parsed, importance_rank; edges: from_path, to_path. Ids are slugs and may be
    equal for different directories; lists of them are ordered by directory.
    """
    assigned, counts = modules(files, roots, least, most)
    key = top_files_by_group(assigned.distinct().join(files.select("path", "importance_rank"), "path").where("module IS NOT NULL"), "module", ["importance_rank", "path"], C.KEY_FILES)
    key = key.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("k")).select("module", F.col("k.path").alias("key_files"))
    pairs = module_edges(assigned.distinct(), edges)
    ids = lambda x: F.transform(F.array_sort(F.collect_set(x)), P.slug)
    outs = pairs.groupBy(F.col("from_module").alias("module")).agg(ids("to_module").alias("depends_on"))
    ins = pairs.groupBy(F.col("to_module").alias("module")).agg(ids("from_module").alias("depended_on_by"))
    other = F.col("module") == "other"
    out = counts.join(key, "module", "left").join(outs, "module", "left").join(ins, "module", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("module").alias("dir"),
        P.slug(F.col("module")).alias("id"),
        F.when(other, "Other").otherwise(P.basename(F.col("module"))).alias("name"),
        F.when(other, "Small modules grouped together.").otherwise(purpose(F.col("module"), F.col("file_count"))).alias("purpose"),
        "file_count",
        *(F.coalesce(c, none).alias(c) for c in ("key_files", "depends_on", "depended_on_by")),
    )


def largest_candidate(files: DataFrame, roots: list[str]) -> DataFrame:
    """dir and number of parsed files of the fullest directory one or two levels below a root: what a corpus without modules
    can be told. Ties go to the smaller path."""
    from quillstone.operators.structure import module_candidates

    at_depth = module_candidates(files, roots).select("dir").distinct()
    direct = files.where("is_parsed").groupBy(P.dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    return direct.join(at_depth, "dir", "left_semi").orderBy(F.desc("n"), "dir").limit(1)


def dominant_module(assigned: DataFrame) -> DataFrame:
    """dir, module: the module that most files at any depth below a directory belong to, ties to the smaller id.
    assigned: path, module."""
    each = assigned.where("module IS NOT NULL").select(F.explode(P.ancestors(F.col("path"))).alias("dir"), P.slug(F.col("module")).alias("module"))
    n = each.groupBy("dir", "module").agg(F.count("*").alias("n"))
    return n.groupBy("dir").agg(F.max("n").alias("most")).join(n, "dir").where("n = most").groupBy("dir").agg(F.min("module").alias("module"))


def reasons(steps: DataFrame, files: DataFrame) -> DataFrame:
    """steps (of graph.roadmap, with evidence for entries) with ``why``. files: id, path, classification, importance_rank,
    in_degree, module (null: none). Steps are a few dozen rows at most."""
    f = files.select("id", "path", "classification", "importance_rank", "in_degree", F.coalesce("module", F.lit("this repository")).alias("module"))
    w = Window.orderBy("order")  # at most ROADMAP_MAX rows
    s = steps.join(f, "id").withColumn("before", F.lag(P.basename(F.col("path"))).over(w))
    n = F.col("in_degree").cast("string")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    why = (
        F.when(F.col("section") == "entry", text("Entry point (", F.coalesce("evidence", F.lit("unknown")), "). Start reading here."))
        .when(F.col("n_companions") > 0, text("Part of a ", (F.col("n_companions") + 1).cast("string"), "-file import cycle; read these together."))
        .when(F.col("importance_rank") <= 3, text("Imported by ", n, " files (rank #", F.col("importance_rank").cast("string"), " by centrality) — the hub of ", F.col("module"), "."))
        .when(F.col("section") == "core", text(F.col("classification"), " used by ", n, " files; reached directly from ", F.coalesce("before", F.lit("the entry point")), "."))
        .when(F.col("section") == "leaf-utility", text("Leaf utility imported by ", n, " files; read last, for reference."))
        .when(F.col("section") == "unreached", "Not reached from any entry point — likely dead code or a separate tool.")
        .otherwise(text(F.col("classification"), " in ", F.col("module"), "; imported by ", n, " files."))
    )
    return s.withColumn("why", why).drop("before", "path", "classification", "importance_rank", "in_degree", "module")


def ask_fallback(hits: DataFrame, important: DataFrame, most: int = C.BUDGET_FILES) -> DataFrame:
    """path and place: the files a search found, or the most important ones where it found none. hits, important: path,
    place."""
    found = hits.select("path", "place")
    instead = important.select("path", "place").join(F.broadcast(found.limit(1).select(F.lit(True).alias("__any"))), how="left")  # one row
    return found.union(instead.where("__any IS NULL").select("path", "place")).where(F.col("place") <= most)
