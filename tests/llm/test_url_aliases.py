"""Aliases of URLs that differ in their queries, and pages with several links."""

from __future__ import annotations

from quillstone.llm import urlfilter

RULES = [("block", "bad.org", "/"), ("allow", "good.org", "/")]


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.verdict for r in urlfilter.judge(df, RULES).collect()}


def refresh(to):
    return f'<meta http-equiv="refresh" content="0; url={to}">'


def test_queries_of_one_path_stay_apart(spark):
    rows = [
        (1, "http://r.fr/go?u=a", refresh("http://bad.org/x")),
        (2, "http://r.fr/go?u=b", refresh("http://plain.fr/y")),
        (3, "http://plain.fr/y", None),
        (4, "http://r.fr/go?utm_source=z&u=a&gclid=1#top", ""),
        (5, "http://r.fr/go", ""),
        (6, "http://s.fr/item?id=1&v=2", '<link rel="canonical" href="?id=9">'),
        (7, "http://s.fr/item?id=9", refresh("http://r.fr/go?u=a&amp;utm_medium=m")),
        (8, "http://s.fr/?id=9", ""),
    ]
    assert verdicts(spark, rows) == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "allow"}


def test_all_links_of_a_page_count(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.fr/1", link % "http://b.fr/1" + link % "http://bad.org/1"),
        (2, "http://b.fr/1", None),
        (3, "http://c.fr/1", refresh("http://d.fr/1") + refresh("http://bad.org/2")),
        (4, "http://d.fr/1", None),
        (5, "http://e.fr/dir/1", link % "#part" + refresh("http://bad.org/3")),
        (6, "http://e.fr/dir/", None),
    ]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}
