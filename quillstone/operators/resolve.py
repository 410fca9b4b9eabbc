"""Import resolution in tiers: relative paths, aliases, workspace packages, external packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.operators.structure import nearest_ancestor
from quillstone.sources.tables import join_hot, keep, sized


def collapse(path: Column) -> Column:
    """A path without ., .. and empty segments; a .. above the root is dropped."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def package_of(specifier: Column) -> Column:
    """The package of a bare specifier: @scope/name or the first segment."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@") & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def _first_existing(bases: DataFrame, files: DataFrame) -> DataFrame:
    """import_id, to_path: of the candidates (import_id, tier_pos, base) with every suffix, the first that exists."""
    suffixes = F.array(*(F.lit(s) for s in [*C.PROBE_SUFFIXES, *C.INDEX_SUFFIXES]))
    each = bases.select("import_id", "tier_pos", F.posexplode(suffixes).alias("pos", "suffix"), "base").select("import_id", "tier_pos", "pos", F.concat("base", "suffix").alias("path"))
    return each.join(files.select("path").distinct(), "path").groupBy("import_id").agg(F.min_by("path", F.struct("tier_pos", "pos")).alias("to_path"))


def _by_pattern(imports: DataFrame, configs: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(import_id, tier_pos, base) of the targets of the most specific fitting pattern, and import_id of all that fit one.

    imports: import_id, path, specifier; configs: dir, base; patterns: dir, pattern (with one ``*`` at
    most), targets. Only the nearest config above a file counts, by an equality join on its ancestors.
    """
    near = nearest_ancestor(imports.select("path").distinct(), configs.select("dir", F.struct("dir", "base").alias("config"))).select("path", "config.*")
    star = F.instr("pattern", "*")
    rules = patterns.select("dir", "pattern", "targets", F.when(star > 0, F.substr("pattern", F.lit(1), star - 1)).otherwise(F.col("pattern")).alias("before"), F.when(star > 0, F.substr("pattern", star + 1)).otherwise(F.lit("")).alias("after"), (star > 0).alias("open"))
    rules = sized(keep(rules), width=F.octet_length("pattern") + F.octet_length(F.array_join("targets", " ")))
    met = imports.join(near, "path").join(rules, "dir")
    fits = F.when(F.col("open"), F.startswith("specifier", "before") & F.endswith("specifier", "after") & (F.length("specifier") >= F.length("before") + F.length("after"))).otherwise(F.col("specifier") == F.col("pattern"))
    best = met.where(fits).groupBy("import_id").agg(F.min_by(F.struct("specifier", "base", "before", "after", "open", "targets"), F.struct((-F.length("before") - F.length("after")).alias("n"), F.col("pattern"))).alias("x")).select("import_id", "x.*")
    capture = F.when(F.col("open"), F.substr("specifier", F.length("before") + 1, F.length("specifier") - F.length("before") - F.length("after"))).otherwise(F.lit(""))
    each = best.select("import_id", "base", capture.alias("capture"), F.posexplode("targets").alias("tier_pos", "target"))
    put = F.when(F.contains("target", F.lit("*")), F.concat(F.substring_index("target", "*", 1), "capture", F.substr("target", F.instr("target", "*") + 1))).otherwise(F.col("target"))
    return each.select("import_id", "tier_pos", collapse(F.concat_ws("/", F.nullif("base", F.lit("")), put)).alias("base")), best.select("import_id")


def resolve(imports: DataFrame, files: DataFrame, configs: DataFrame, patterns: DataFrame, packages: DataFrame, package_imports: DataFrame | None = None) -> DataFrame:
    """import_id, outcome (edge, external, unresolved), to_path, package, reason of imports (import_id, path, specifier).

    Tiers, the first that a specifier belongs to: ``./`` and ``../`` from the importing file; ``#`` names
    by the nearest package that declares them (package_imports: dir, pattern, targets); the nearest
    config's patterns (configs: dir, base; patterns: dir, pattern, targets), the most specific
    that fits, its targets in order; workspace packages (name, dir, entry or null); else external. A specifier
    stays in its tier: without a file it is unresolved, by a pattern alias-unmapped, else no-match-on-disk.
    """
    base = keep(imports.select("import_id", "path", "specifier", F.when(F.col("specifier").rlike(r"^\.{1,2}/"), "relative").when(F.startswith("specifier", F.lit("#")), "hash").otherwise("bare").alias("form")))
    rel = base.where("form = 'relative'").select("import_id", F.lit(0).alias("tier_pos"), collapse(F.concat_ws("/", P.dirname(F.col("path")), "specifier")).alias("base"))
    bare = base.where("form = 'bare'")
    aliased, is_alias = _by_pattern(bare, configs, patterns)
    is_alias = keep(is_alias)
    if package_imports is not None:
        own = package_imports.select("dir").distinct().withColumn("base", F.col("dir"))
        hashed, fits = _by_pattern(base.where("form = 'hash'"), own, package_imports)
        aliased, is_alias = aliased.union(hashed), is_alias.union(keep(fits))
    rest = bare.join(is_alias, "import_id", "left_anti")
    named = sized(keep(packages.select("name", "dir", F.coalesce("entry", F.lit("index")).alias("entry"))), width=F.octet_length(F.concat_ws(" ", "name", "dir", "entry")))
    scope = rest.withColumn("package", package_of(F.col("specifier")))
    # a package's name is the specifier's first one or two segments, so an equality join finds it
    space = scope.join(named, scope["package"] == named["name"])
    tail = F.substr("specifier", F.length("name") + 2)
    space = space.select("import_id", F.lit(0).alias("tier_pos"), collapse(F.concat_ws("/", F.nullif("dir", F.lit("")), F.when(F.col("specifier") == F.col("name"), F.col("entry")).otherwise(tail))).alias("base"))
    space = keep(space)
    found = _first_existing(rel.union(aliased).union(space), files)
    out = base.join(is_alias.withColumn("is_alias", F.lit(True)), "import_id", "left").join(space.select("import_id", F.lit(True).alias("is_space")).distinct(), "import_id", "left").join(found, "import_id", "left")
    gone = (F.col("form") != "bare") | F.col("is_alias").isNotNull() | F.col("is_space").isNotNull()
    out = out.withColumn("outcome", F.when(F.col("to_path").isNotNull(), "edge").when(gone, "unresolved").otherwise("external"))
    return out.select(
        "import_id",
        "outcome",
        "to_path",
        F.when(F.col("outcome") == "external", package_of(F.col("specifier"))).alias("package"),
        F.when(F.col("outcome") == "unresolved", F.when(F.col("is_alias").isNotNull(), "alias-unmapped").otherwise("no-match-on-disk")).alias("reason"),
    )


def resolve_python(imports: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """import_id, outcome (edge, stdlib, external, unresolved), to_path, package of Python imports (import_id, path, specifier).

    Leading dots walk up from the importing file; absolute names are tried below each root, longest
    root first. Of the candidates of one base, ``m.py`` goes before ``m/__init__.py``, then the
    same for the module that holds the imported name, then any file of a namespace folder. What no root has is
    the standard library's, by a fixed table, or an external package.
    """
    ordered = sorted(roots, key=lambda r: (-len(r), r))
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    name = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = imports.select("import_id", "path", "specifier", dots.alias("dots"), name.alias("name"))
    up = F.array_join(F.slice(P.segments(P.dirname(F.col("path"))), 1, F.greatest(F.size(P.segments(P.dirname(F.col("path")))) - F.col("dots") + 1, F.lit(0))), "/")
    starts = F.when(F.col("dots") > 0, F.array(up)).otherwise(F.array(*(F.lit(r) for r in ordered)))
    # imports that ask for the same are answered once; what many ask for, as a standard module, fills no task
    base = keep(base.withColumn("starts", starts).withColumn("asked", F.concat_ws("\0", F.concat_ws("\1", "starts"), "name")))
    asked = keep(base.groupBy("asked").agg(F.count("*").alias("n"), F.first("starts").alias("starts"), F.first("name").alias("name")))
    each = asked.select("asked", F.posexplode("starts").alias("tier", "start"), "name")
    whole = F.regexp_replace(F.concat_ws("/", F.nullif("start", F.lit("")), F.nullif("name", F.lit(""))), "/+$", "")
    holder = P.dirname(whole)
    candidates = F.array(F.concat(whole, F.lit(".py")), F.concat(whole, F.lit("/__init__.py")), F.concat(holder, F.lit(".py")), F.concat(holder, F.lit("/__init__.py")), F.concat(whole, F.lit("/")))
    each = each.select("asked", "tier", F.posexplode(candidates).alias("pos", "candidate"))
    known = files.select(F.col("path").alias("candidate"), "path").union(files.where(P.ext(F.col("path")) == "py").groupBy(F.concat(P.dirname(F.col("path")), F.lit("/")).alias("candidate")).agg(F.min("path").alias("path")))
    found = each.join(known, "candidate").groupBy("asked").agg(F.min_by("path", F.struct("tier", "pos")).alias("to_path"))
    top = F.substring_index("specifier", ".", 1)
    out = join_hot(base, keep(asked.select("asked", "n").join(found, "asked", "left")), "asked", "n")
    kind = F.when(F.col("to_path").isNotNull(), "edge").when(F.col("dots") > 0, "unresolved").when(top.isin(C.PYTHON_STDLIB), "stdlib").otherwise("external")
    return out.select("import_id", kind.alias("outcome"), "to_path", F.when(F.col("to_path").isNull() & (F.col("dots") == 0), top).alias("package"))
