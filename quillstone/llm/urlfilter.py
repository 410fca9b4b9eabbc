"""URL filters whose block decisions reach aliases by redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import components, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
#: Parameters that name where a visitor came from, not what the server answers.
TRACKING = r"(?i)^(?:utm_\w+|gclid|dclid|fbclid|msclkid|mc_cid|mc_eid)(?:=|$)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(rules: list[tuple[str, str, str]], h: Column, p: Column) -> Column:
    """The longest rule (action, host, path) that fits, as struct action, rule; null: none. Of equally long rules an
    allow goes first. Rules are a parameter of the job, compiled into one expression."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    fits = lambda rule: ((h == rule[1]) | h.endswith("." + rule[1])) & p.startswith(rule[2])
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r[0]).alias("action"), F.lit(r[1] + r[2]).alias("rule"))) for r in ordered), F.lit(None).cast("struct<action:string,rule:string>"))


def query(url: Column) -> Column:
    """What follows the ?, without tracking parameters."""
    parts = F.split(F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit("")), "&")
    return F.array_join(F.filter(parts, lambda x: (x != "") & ~x.rlike(TRACKING)), "&")


def alias_key(h: Column, p: Column, q: Column) -> Column:
    """URLs that a server answers alike: without www., a default port, an index page, a closing slash or tracking parameters."""
    h = F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r":(?:80|443)$", "")
    return F.concat(h, F.regexp_replace(F.regexp_replace(p, r"/index\.html?$", "/"), r"/+$", ""), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def redirect_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) by all canonical links and refresh redirects that the pages themselves declare."""
    u, h = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    every = lambda tag, link: F.transform(F.regexp_extract_all(h, F.lit(tag), F.lit(0)), lambda x: F.regexp_replace(F.regexp_extract(x, link, 1), r"(?i)&(?:amp|#38|#x26);", "&"))
    to = F.concat(every(CANONICAL, HREF), every(REFRESH, REFRESH_TO))
    root = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    each = pages.where(u.contains("://")).select(u.alias("from_url"), root.alias("root"), folder.alias("folder"), F.explode(to).alias("to")).where("`to` <> ''")
    to = F.col("to")
    full = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract("root", r"^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat("root", to))
        .when(to.startswith("?"), F.concat(F.regexp_extract("from_url", r"(?s)^[^?#]*", 0), to))
        .when(to.startswith("#"), F.concat(F.regexp_extract("from_url", r"(?s)^[^#]*", 0), to))
        .when(F.col("folder") == F.col("root"), F.concat("root", F.lit("/"), to))
        .otherwise(F.concat("folder", to))
    )
    return each.select("from_url", full.alias("to_url"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Judges every page: id_col, host, path, rule (null: none fits), verdict (allow or block).

    A page's own rule decides. Other pages follow their aliases, the connected component over
    redirect and canonical edges (``edges``: from_url, to_url; by default what the pages declare):
    allow if a URL of it has an allow rule, else block if one has a block rule, else allow. URLs of
    equal alias_key() are one node of the graph as soon as one of them is an end of an edge, also of an edge
    between two of them (a canonical link from a URL to its own form with www., a closing slash, ...);
    without any edge they are judged apart. A null URL, or one without ``://``, has empty host and path, no rule and no aliases. One row for each
    row of pages, repeated ones too; an empty table gives none; other columns are not read.
    """
    edges = redirect_edges(pages, url_col, html_col) if edges is None else edges.select("from_url", "to_url")

    def keyed(url: Column) -> list[Column]:
        return [alias_key(host(url), path(url), query(url)).alias("key"), fitting_rule(rules, host(url), path(url))["action"].alias("action")]

    edges = keep(edges.where("from_url LIKE '%://%' AND to_url LIKE '%://%'").select(F.struct(*keyed(F.col("from_url"))).alias("x"), F.struct(*keyed(F.col("to_url"))).alias("y")))
    own = pages.select(id_col, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), alias_key(host(F.col(url_col)), path(F.col(url_col)), query(F.col(url_col))).alias("alias"))
    own = own.withColumn("fit", fitting_rule(rules, F.col("host"), F.col("path")))
    if edges.isEmpty():
        return own.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", F.lit("allow")).alias("verdict"))
    nodes = edges.selectExpr("x.key AS node").union(edges.selectExpr("y.key AS node")).distinct()
    linked = components(edges.selectExpr("x.key AS a", "y.key AS b"))
    linked = keep(nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    # A page's own rule counts for its aliases too, whichever form of the URL has it.
    named = edges.select("x.key", "x.action").union(edges.select("y.key", "y.action")).union(own.select(F.col("alias").alias("key"), "fit.action").where("action IS NOT NULL"))
    seeds = named.where("action IS NOT NULL").distinct().join(linked.withColumnRenamed("node", "key"), "key")
    decided = seeds.groupBy("component").agg(F.when(F.bool_or(F.col("action") == "allow"), F.lit("allow")).otherwise(F.lit("block")).alias("passed_on"))
    aliases = keep(linked.join(decided, "component").selectExpr("node AS key", "passed_on"))
    out = own.withColumnRenamed("alias", "key").join(aliases, "key", "left")
    return out.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", "passed_on", F.lit("allow")).alias("verdict"))
