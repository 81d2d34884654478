"""Exact dedup and url rules."""

import hashlib
import re
from collections import defaultdict

from rowloom.llm import exact_dedup, url_filter
from rowloom.llm.components import components


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups[norm].append(r)
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        for r in own:
            out.append((r[0], keep, len(own), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_of_odd_rows(odd_docs, odd_rows):
    for run_rows in (1, 4, 1000):  # many runs and levels, and one
        got = exact_dedup.exact_groups(odd_docs, run_rows).collect()
        assert sorted(map(tuple, got), key=str) == brute(odd_rows)


def test_a_large_group_of_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat(id, ' x') ELSE 'copy of all' END AS text")
    got = exact_dedup.exact_groups(docs, 16).groupBy("group_size").count().collect()
    assert {(r["group_size"], r["count"]) for r in got} == {(1, 1000), (2000, 2000)}


def test_no_documents(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "src long, dst long")).collect()))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


PAGES = [
    (1, "http://a.example.org/x", '<link rel="canonical" href="https://sub.example.net/es/y">'),
    (2, "https://sub.Example.NET/es/y#frag", None),
    (3, "https://b.example.org/p?utm_source=q", "<META HTTP-EQUIV=refresh content='0; url=/q'>"),
    (4, "https://b.example.org/q", "<link href='//a.example.org/x' rel=canonical>"),
    (5, "https://c.example.org/", '<link rel="canonical" href="http://www.example.com/en/z"><link rel=canonical href="http://sub.example.net/fr/1">'),
    (6, "https://www.example.com/en/z", ""),
    (7, "https://example.com/en/z", ""),
    (8, "https://notexample.com/en/z", ""),
    (9, "no scheme at all", '<link rel="canonical" href="https://x.net/es/">'),
    (10, None, None),
    (11, "", ""),
    (12, "https://d.example.org?x=1", '<link rel="stylesheet" href="https://x.net/es/">'),
    (12, "https://d.example.org?x=1", '<link rel="stylesheet" href="https://x.net/es/">'),
    (None, "HTTPS://NET/fr/", "<"),
]


def test_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' AS node", "'clash' AS component", "'clash' AS best")
    rows = url_filter.judge(pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == ("a.example.org", "/x", None, "block")  # its canonical page is blocked
    assert got[2] == ("sub.example.net", "/es/y", "net/es/", "block")
    assert got[3] == ("b.example.org", "/p", None, "block")  # refresh, then canonical, then blocked
    assert got[4][3] == "block"
    assert got[5] == ("c.example.org", "/", None, "allow")  # an explicit allow among its aliases goes first
    assert got[6] == ("www.example.com", "/en/z", "www.example.com/en/", "allow")
    assert got[7] == ("example.com", "/en/z", "example.com/en/", "block")
    assert got[8] == ("notexample.com", "/en/z", "com/", "allow")
    assert got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[12] == ("d.example.org", "", None, "allow")
    assert got[None] == ("net", "/fr/", "net/fr/", "block")


def test_aliases_as_sql(spark):
    import duckdb

    from rowloom.llm import sql

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    want = con.sql(sql.url_filter()).fetchall()
    got = url_filter.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
