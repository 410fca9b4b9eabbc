"""Tables that stand in for a source corpus, derived from the given ones by SQL that Spark and DuckDB both run.

``{name}`` stands for a table. files: paths from parts; edges: parts that follow one another in an order; sources: texts
with a part's values in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.tables import table

DIRS = ["src", "src/routes", "src/services", "src/models", "src/components", "src/hooks", "src/utils", "src/store", "src/core/lib", "app", "app/api", "app/pages/admin", "tests", "src/__tests__", "docs/guide", "config", "scripts", "fixtures/data", "packages/web/src", "packages/api/src", "packages/api/src/routes", "tools/gen", "node_modules/left", "src/dist/out"]
EXTS = [".ts", ".tsx", ".js", ".py", ".json", ".md", ".css", ".test.ts", ".html", ".min.js", ".png", ".pb.go", ".jsx", "_test.py", ".yaml", ".sql"]


def _pick(by: str, values: list[str]) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


FILES = f"""
SELECT p_partkey AS id, path, CAST(p_size * 100 AS BIGINT) AS size_bytes, CAST(p_partkey * 7 % 401 AS BIGINT) AS line_count, p_partkey % 10 <> 0 AS is_parsed, p_name AS name, p_brand AS brand, p_type AS kind
FROM (SELECT *, {_pick(f"p_partkey % {len(DIRS)}", DIRS)} || '/' ||
    CASE WHEN p_partkey % 41 = 0 THEN 'main' || p_size WHEN p_partkey % 37 = 0 THEN 'main' WHEN p_partkey % 23 = 0 THEN 'useThing' || p_partkey WHEN p_partkey % 19 = 0 THEN 'Panel' || p_partkey ELSE replace(p_name, ' ', '-') || p_partkey END ||
    {_pick(f"p_size % {len(EXTS)}", EXTS)} AS path FROM {{part}})
"""
#: Parts that follow one another in an order: at every size one large strongly connected component.
EDGES = """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey
"""
#: The same pairs, pointed from the lower of four layers (id modulo 4) to the higher one, free within a layer: components
#: of every size, as source trees have them. Every pair is used.
LAYERED = """
SELECT DISTINCT CASE WHEN src % 4 <= dst % 4 THEN src ELSE dst END AS src, CASE WHEN src % 4 <= dst % 4 THEN dst ELSE src END AS dst
FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)
"""
#: A script and a Python module for each part.
SCRIPTS = r"""
SELECT id, replace(path, '.', '_') || '.ts' AS path, concat('// import gone from "./commented";\nimport {{\n  a,\n  b,\n}} from "./m', size_bytes, '";\nimport type {{ T }} from "../t', id % 7, '";\n/* require("no")\n*/ export * from "pkg-', id % 5, '/sub";\nconst q = require("lib', id % 3, '");\nexport class K', id, ' {{\n  run(x: number): void {{\n    const s = "import(9)"; import("./lazy', id % 4, '");\n  }}\n}}\nexport const use', brand_word, ' = () => {{\n  return 1;\n}};\n') AS text
FROM (SELECT *, replace(brand, '#', '') AS brand_word FROM files)
"""
MODULES = r"""
SELECT id, 'src/mod' || id || '.py' AS path, concat('import os.path\nfrom ..p', id % 6, ' import (\n    x,\n    y as z,\n)\nLIMIT = ', id, '\n\n@app.get("/items/', id % 9, '")\ndef handle_', id, '(a):\n    # from nowhere import nothing\n    return a\n\nclass Thing', id % 11, ':\n    def _run(self):\n        pass\n', CASE WHEN id % 13 = 0 THEN 'def broken(:\n' ELSE '' END, CASE WHEN id % 8 = 0 THEN 'if __name__ == "__main__":\n    main()\n' ELSE '' END) AS text
FROM files
"""
URL_PATHS = "SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS path FROM {pages}"
CODE = "SELECT doc_id, source || '/doc' || doc_id || '.md' AS path, coalesce(text, '') AS text, lang FROM {documents}"


def base(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def sources(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Source texts (SCRIPTS, MODULES) for every file, dealt over all cores however few row groups the rows lie in: a row is
    small, reading and parsing its text isn't."""
    files = base(spark, sf_dir, FILES)
    return spark.sql(sql.replace("FROM files", "FROM {files}"), files=files.repartition(4 * spark.sparkContext.defaultParallelism))


def duck(sql: str) -> str:
    """The same SQL over registered views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
