"""URL rules whose block decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.components import components
from rowloom.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Query parameters that name a campaign, not a page.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"

TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
TARGET = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, else null.

    ``rules`` is a parameter list, planned as one literal array. Among rules of
    one length that both fit, allow comes first.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(len(h) + len(p)).alias("size"),
                F.lit(int(v == ALLOW)).alias("allows"),
                F.lit(h + p).alias("rule"),
                F.lit(v).alias("verdict"),
                F.lit(h).alias("host"),
                F.lit(p).alias("path"),
            )
            for v, h, p in rules
        ]
    )
    fits = F.filter(
        listed,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.array_max(fits)


def page_key(url: Column) -> Column:
    """The page behind a url: host, path and the query without campaign parameters, in order; no scheme, no fragment."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host_of(url), path_of(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as found on the page at ``url``; null where it leads to no web page."""
    base = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(base, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None).cast("string"))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst page keys: canonical links and meta redirects in the html of each page."""
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    tags = pages.select("url", F.explode(F.regexp_extract_all(html, F.lit(TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    link = F.when(tag.rlike(CANONICAL), F.regexp_extract(tag, HREF, 1)).when(tag.rlike(REFRESH), F.regexp_extract(tag, TARGET, 1))
    found = tags.select("url", link.alias("link")).filter("link IS NOT NULL AND link <> ''")
    return (
        found.select(page_key(url).alias("src"), page_key(_absolute(F.col("link"), url)).alias("dst"))
        .filter("src <> '' AND dst <> ''")
        .distinct()
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component - one row per row of ``pages``.

    A url that a rule fits has that rule's verdict. Any other takes the verdict
    of its alias group, the connected component of its page over redirects and
    canonical links: allow if any page of the group has an explicit allow, else
    block if any has a block, else allow. Link targets count as pages of the group even
    where they are not in the table.

    Null url or no scheme: host and path empty, no rule, allow. Null html: no
    links. Repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
    """
    url = F.col("url")
    own = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), page_key(url).alias("node")
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    # A page key starts with its host and path, so that it can be judged like a url.
    groups = stage(components(alias_edges(pages)), "aliases")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = groups.withColumn("best", best_rule(host_of(as_url), path_of(as_url), rules))
    verdicts = ruled.groupBy("component").agg(
        F.max((F.col("best.verdict") == ALLOW).cast("int")).alias("allows"),
        F.max((F.col("best.verdict") == BLOCK).cast("int")).alias("blocks"),
    )
    reached = groups.join(verdicts, "component").select(
        "node",
        "component",
        F.when(F.col("allows") == 1, F.lit(ALLOW)).when(F.col("blocks") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("spread"),
    )
    return own.join(reached, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), "spread", F.lit(ALLOW)).alias("verdict"),
        "component",
    )
