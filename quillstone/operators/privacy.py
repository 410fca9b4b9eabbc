"""Snippets, budgets, redaction of whole requests and verification of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.functions import text as T
from quillstone.sources.tables import running

PLACE = r"([A-Za-z0-9_@./-]+\.[A-Za-z0-9]+)(?::([0-9]+))?"
#: Places are cited in code spans and as link targets.
CITATIONS = [f"`{PLACE}`", rf"\]\({PLACE}\)"]


#: Up to so many snippets a request, Spark passes on no more than these of each task's rows.
FEW = 1000


def within_budget(snippets: DataFrame, key: str, order: list[Column], size: str, most: int = C.BUDGET_FILES, most_bytes: int = C.BUDGET_BYTES) -> DataFrame:
    """The longest prefix of each request whose number and running size stay within the budget; it stops at the first
    snippet that doesn't fit. ``order`` tells a request's snippets apart.

    A small budget takes the first ``most`` of every task before anything is shuffled; a large one sums up over ranges
    (running()). Either way a request with most of the rows fills no task.
    """
    if most <= FEW:
        first = snippets.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)
        w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        return first.withColumn("place", F.col("place").cast("long")).withColumn("bytes_so_far", F.sum(size).over(w)).where(F.col("bytes_so_far") <= most_bytes)
    rows = running(snippets, key, order, {"place": F.lit(1).cast("long"), "bytes_so_far": F.col(size).cast("long")})
    return rows.where((F.col("place") <= most) & (F.col("bytes_so_far") <= most_bytes))


def redacted(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files with secrets replaced, without files that are excluded whole."""
    return files.where(~T.is_excluded_file(F.col(path))).withColumn(text, T.redact(F.col(text)))


def unstable(files: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose redacted text a second pass would still change; a request with any is to be refused."""
    # the first pass is computed once a row, and a text that it leaves as it is needs no second one
    return files.where(F.exists(F.array(T.redact(F.col(text))), lambda once: (once != F.col(text)) & (T.redact(once) != once)))


def citations(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, path, line of every cited place in code spans and link targets."""
    spans = F.concat(*(F.regexp_extract_all(F.col(text), F.lit(c), F.lit(0)) for c in CITATIONS))
    each = answers.select(key, F.explode(spans).alias("c"))
    return each.select(key, P.normalize(F.regexp_extract("c", PLACE, 1)).alias("path"), F.nullif(F.regexp_extract("c", PLACE, 2), F.lit("")).cast("int").alias("line"))


def verified(answers: DataFrame, index: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n_cited, is_valid: valid if it cites something and every cited path is known with the line within it.
    index: path, line_count."""
    found = citations(answers, key, text).join(index.select("path", "line_count"), "path", "left")
    right = F.col("line_count").isNotNull() & (F.col("line").isNull() | F.col("line").between(1, F.col("line_count")))
    counts = found.groupBy(key).agg(F.count("*").alias("n_cited"), F.bool_and(right).alias("ok"))
    forged = F.col(text).contains("[[")
    return answers.select(key, forged.alias("forged")).join(counts, key, "left").select(key, F.coalesce("n_cited", F.lit(0)).alias("n_cited"), (F.coalesce("ok", F.lit(False)) & ~F.coalesce("forged", F.lit(False))).alias("is_valid"))
