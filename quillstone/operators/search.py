"""Token postings and ranked keyword search with synonyms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import constants as C
from quillstone.functions import paths as P
from quillstone.functions import text as T
from quillstone.sources.index import names_with
from quillstone.sources.tables import keep, sized


#: Postings after which a task passes on what it has.
POSTINGS_AT_ONCE = 1 << 15
_RAW = re.compile(r"[A-Za-z0-9_]+")
_JOINTS = (re.compile("[_-]+"), re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])"))


@lru_cache(1 << 17)
def _words(raw: str) -> tuple[str, ...]:
    """text.tokens() of one run of letters, digits and underscores."""
    spaced = _JOINTS[2].sub(r"\1 \2", _JOINTS[1].sub(r"\1 \2", _JOINTS[0].sub(" ", raw)))
    words = [w for w in spaced.split(" ") if w]
    if len(words) > 1:
        words.append(raw)
    return tuple(w for w in map(str.lower, words) if len(w) >= C.MIN_TERM)


def _count(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """The postings of batches (path, text), some POSTINGS_AT_ONCE at a time, so a task's memory doesn't grow with its batches."""
    for batch in batches:
        tokens, which, counts, sizes, lines = [], [], [], [], []
        for i in range(len(batch)):
            n: dict[str, int] = {}
            at: dict[str, list[int]] = {}
            for k, line in enumerate((batch.column(1)[i].as_py() or "").split("\n"), 1):
                for raw in _RAW.findall(line):
                    for token in _words(raw):
                        if wanted is not None and token not in wanted:
                            continue
                        if token not in n:
                            n[token], at[token] = 1, [k]
                            continue
                        n[token] += 1
                        own = at[token]
                        if own[-1] != k and len(own) < C.LINES_PER_TOKEN:
                            own.append(k)
            tokens += n
            which += [i] * len(n)
            counts += n.values()
            sizes += map(len, at.values())
            lines += chain.from_iterable(at.values())
            if len(tokens) >= POSTINGS_AT_ONCE or i == len(batch) - 1:
                begin = pa.array([0, *accumulate(sizes)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), batch.column(0).take(pa.array(which, pa.int64())), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(begin, pa.array(lines, pa.int32()))], ["token", "path", "count", "lines"])
                tokens, which, counts, sizes, lines = [], [], [], [], []


def postings(files: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """token, path, count, lines (the first 20 different ones, ascending) of files (path, text), whose paths are unique.

    A file's postings come out of its own row, so nothing is shuffled. With ``terms``, only these
    tokens count, and texts that hold none of them are passed over.
    """
    wanted = None if terms is None else frozenset(terms)
    if wanted is not None:
        files = files.where(F.lower("text").rlike("|".join(sorted(map(re.escape, wanted))) or "$^"))

    return files.select("path", "text").mapInArrow(lambda batches: _count(batches, wanted), "token string, path string, count long, lines array<int>")


def indexable(files: DataFrame) -> DataFrame:
    """Files (text) without those that the skip rules leave out: unread, binary, too large, minified. Languages that aren't
    parsed are indexed."""
    text = F.col("text")
    return files.where(text.isNotNull() & T.skip_reason(F.octet_length(text), text, F.lit(True)).isNull())


def contains(rows: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Rows whose column holds one of some literal strings; none of them is read as a pattern."""
    test = F.lit(False)
    for part in parts:
        test = test | F.contains(column, F.lit(part))
    return rows.where(test)


def merged_keywords(own: dict[str, list[str]], base: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The keyword map with the user's entries in place of those of the same key."""
    return {**(C.KEYWORDS if base is None else base), **own}


def expand(spark: SparkSession, queries: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """query, term, weight of many queries (query) at once: their terms, and synonyms at less weight; the largest weight of
    a term counts."""
    keywords = C.KEYWORDS if keywords is None else keywords
    terms = queries.distinct().select("query", F.explode(T.query_terms(F.col("query"))["terms"]).alias("term"))
    known = spark.createDataFrame([(k, s) for k, v in keywords.items() for s in v], "term string, synonym string")  # a configuration
    more = terms.join(F.broadcast(known), "term").select("query", F.col("synonym").alias("term"), F.lit(C.EXPANSION_DECAY).alias("weight"))
    return terms.withColumn("weight", F.lit(1.0)).union(more).groupBy("query", "term").agg(F.max("weight").alias("weight"))


def term_weights(query: str, keywords: dict[str, list[str]] | None = None) -> tuple[dict[str, float], list[str]]:
    """Weight by term of a query, and the terms dropped as too short. A concept's synonyms weigh less; the first weight wins."""
    keywords = C.KEYWORDS if keywords is None else keywords
    raw = sorted({t for t in re.split(r"[^a-z0-9_]+", query.lower()) if t})
    terms = [t for t in raw if len(t) >= C.MIN_TERM]
    out = dict.fromkeys(terms, 1.0)
    for t in terms:
        for s in keywords.get(t, []):
            out.setdefault(s, C.EXPANSION_DECAY)
    return dict(sorted(out.items())), [t for t in raw if len(t) < C.MIN_TERM]


def answer(spark: SparkSession, files: DataFrame, symbols: DataFrame, index: DataFrame, query: str, limit: int = 50, keywords: dict[str, list[str]] | None = None, grams: str | None = None) -> tuple[DataFrame, list[str]]:
    """search() and the terms that were dropped as too short. A query without any usable term has no hits, and nothing is
    read for it."""
    weights, dropped = term_weights(query, keywords)
    hits = search(spark, files, symbols, index, query, limit, keywords, grams)
    return (hits if weights else spark.createDataFrame([], hits.schema)), dropped


def search_names(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The names (name) that search() looks into, as gram_postings() takes them: symbols and file stems in lower case."""
    return symbols.select(F.lower("name").alias("name")).union(files.select(F.lower(P.stem(F.col("path")))))


def search(spark: SparkSession, files: DataFrame, symbols: DataFrame, index: DataFrame, query: str, limit: int = 50, keywords: dict[str, list[str]] | None = None, grams: str | None = None) -> DataFrame:
    """The best files for a query: path, score, match_kinds, best_symbol, lines.

    With ``grams``, a folder of save_grams() over search_names(), only the names that hold a term are
    read from it, and symbols and files are joined with them by equality; without, every name is compared with every term.

    files: path, classification, importance; symbols: path, name, is_exported; index: as postings().
    Points of each term and file add up by weight, then importance and a penalty by class. Terms are
    a query's, so their table is broadcast; files are only filtered by it. Every file with points is scored; the surveyed
    feature scores the first 2,000 by path.
    """
    weights, _ = term_weights(query, keywords)
    terms = F.broadcast(spark.createDataFrame(list(weights.items()), "term string, weight double"))
    tier = F.when(F.col("nm") == F.col("term"), C.SYMBOL_EXACT).when(F.col("nm").startswith(F.col("term")), C.SYMBOL_PREFIX).otherwise(C.SYMBOL_SUBSTRING)
    named = symbols.withColumn("nm", F.lower("name"))
    if grams is None:
        hit = named.join(terms, F.contains("nm", "term"))
    else:
        holding = keep(names_with(spark, grams, list(weights)).withColumnsRenamed({"part": "term", "name": "nm"}).join(terms, "term"))
        hit = named.join(sized(holding, width=F.octet_length("nm") + 16), "nm")
    hit = hit.withColumn("tier", tier)
    w = Window.partitionBy("path", "term").orderBy(F.desc("tier"), F.desc("is_exported"), "name")
    hit = hit.withColumn("k", F.row_number().over(w)).where("k = 1").select("path", "term", "weight", F.lit("symbol").alias("source"), (F.col("tier") + F.when(F.col("is_exported"), C.EXPORTED_BONUS).otherwise(0.0)).alias("points"), F.when(F.col("tier") == C.SYMBOL_EXACT, "symbol-exact").when(F.col("tier") == C.SYMBOL_PREFIX, "symbol-prefix").otherwise("symbol-substring").alias("kind"), "name", F.lit(None).cast("array<int>").alias("lines"))
    stem = F.lower(P.stem(F.col("path")))
    parts = F.transform(P.segments(F.col("path")), F.lower)
    named = files.select("path", stem.alias("stem"), parts.alias("parts"))
    if grams is None:
        named = named.join(terms, F.contains("stem", "term") | F.array_contains("parts", F.col("term")))
    else:
        by_stem = named.join(sized(holding.withColumnRenamed("nm", "stem"), width=F.octet_length("stem") + 16), "stem")
        by_part = named.withColumn("term", F.explode(F.array_distinct("parts"))).join(terms, "term").where(~F.contains("stem", "term"))
        named = by_stem.unionByName(by_part)
    name_kinds = F.array(
        F.when(F.col("stem") == F.col("term"), F.struct(F.lit(C.FILENAME_EXACT).alias("p"), F.lit("filename-exact").alias("k"))).when(F.contains("stem", "term"), F.struct(F.lit(C.FILENAME_SUBSTRING).alias("p"), F.lit("filename-substring").alias("k"))),
        F.when(F.array_contains("parts", F.col("term")), F.struct(F.lit(C.PATH_SEGMENT).alias("p"), F.lit("path-segment").alias("k"))),
    )
    named = named.select("path", "term", "weight", F.explode(name_kinds).alias("x")).where("x IS NOT NULL").select("path", "term", "weight", F.lit("name").alias("source"), "x.p", "x.k", F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<int>").alias("lines"))
    text = index.join(terms, F.col("token") == F.col("term")).select("path", "term", "weight", F.lit("content").alias("source"), F.least(4 * F.log2(1.0 + F.col("count")), F.lit(C.CONTENT_CAP)).alias("points"), F.lit("content").alias("kind"), F.lit(None).cast("string").alias("name"), "lines")
    points = hit.union(named).union(text)
    order = F.array(*(F.lit(k) for k in ("symbol-exact", "symbol-prefix", "symbol-substring", "filename-exact", "filename-substring", "path-segment", "content")))
    per_file = points.groupBy("path").agg(F.sum(F.col("points") * F.col("weight")).alias("total"), F.array_intersect(order, F.collect_set("kind")).alias("match_kinds"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("term"))).alias("best_symbol"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))), 1, C.LINE_HITS).alias("lines"))
    penalty = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in C.PENALTY.items() for x in kv)), F.col("classification")), F.lit(0.0))
    scored = per_file.join(files, "path").select("path", F.round(F.greatest(F.col("total") + C.W_IMPORTANCE * F.col("importance") + penalty, F.lit(0.0)), 3).alias("score"), "match_kinds", "best_symbol", "lines", "importance")
    return scored.orderBy(F.desc("score"), F.desc("importance"), "path").limit(limit).drop("importance")


def line_previews(hits: DataFrame, files: DataFrame, terms: list[str]) -> DataFrame:
    """path, line and preview for the lines of search hits."""
    each = hits.select("path", F.explode("lines").alias("line")).join(files.select("path", "text"), "path")
    return each.select("path", "line", T.preview(F.coalesce(F.get(F.split("text", "\n"), F.col("line") - 1), F.lit("")), terms).alias("preview"))
