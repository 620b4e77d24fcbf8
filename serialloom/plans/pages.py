"""Queries over whole pages: what profiles find, paragraphs, links, embedded lists and paged tables of contents, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extraction, html, text, urls
from . import adapters as a
from .catalog import query

#: The supplied pages are of three top domains, each read by rules of its own.
PAGE_RULES = (
    extraction.rule("com", "title", "h1.novel-title"),
    extraction.rule("com", "title", "body > article > h1", 2),
    extraction.rule("com", "lang", "html[lang]", attribute="lang"),
    extraction.rule("com", "author", "div.ad"),
    extraction.rule("net", "title", 'meta[property="og:title"]', attribute="content"),
    extraction.rule("net", "title", "head title", 2, clean="head"),
    extraction.rule("net", "cover_url", 'nav li > a[href^="/"]', attribute="href"),
    extraction.rule("net", "status_hint", "nav a", every=True),
    extraction.rule("org", "title", "article h1, h2"),
    extraction.rule("org", "author", "body > div[class~=ad]", clean="behind_colon"),
    extraction.rule("org", "lang", "[lang]", attribute="lang"),
)


def _plain(x: str) -> str:
    """The text of a piece of a page without tags: its references resolved, trimmed."""
    return f"trim(regexp_replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g'))"


@query(
    rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*\.([a-z]+)', 1) AS profile, {_plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1, {_plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS t,
    {_plain("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS ad, {_plain("regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)")} AS lang, {_plain("regexp_extract(html, '<nav><ul><li><a href=\"(/[^\"]*)\"', 1)")} AS href FROM pages)
SELECT page_id, profile, nullif(CASE profile WHEN 'net' THEN trim(regexp_replace(t, '\|[^|]*$', '')) ELSE h1 END, '') AS title, nullif(CASE profile WHEN 'com' THEN ad WHEN 'org' THEN trim(CASE WHEN contains(ad, ':') THEN regexp_replace(ad, '^[^:]*:', '') ELSE ad END) END, '') AS author,
CASE WHEN profile = 'net' THEN nullif(href, '') END AS cover_url, CASE WHEN profile <> 'net' THEN nullif(lang, '') END AS lang FROM p"""
)
def page_profile_fields(spark, d):
    """Every page by the profile of its host; the hosts that are served are those of the pages."""
    pages = a.table(spark, d, "pages").select("page_id", "url", "html")
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct()
    served = hosts.select(F.lit(1).alias("rank"), F.regexp_extract("host", r"\.([a-z]+)$", 1).alias("profile"), "host", F.lit(False).alias("with_www"), F.lit(None).cast("string").alias("chapter_marker"), F.lit(None).cast("string").alias("page_param"), F.lit(None).cast("int").alias("max_pages"))
    rules = spark.createDataFrame(list(PAGE_RULES), extraction.RULES)
    found = extraction.extract(extraction.with_profile(pages, served), rules)
    return found.select("page_id", "profile", "title", "author", "cover_url", "lang")


@query(
    rf"""WITH s AS (SELECT page_id, string_split(regexp_replace(html, '(?s)^.*?</style>|<script>.*?</script>', '', 'g'), '<p>') AS parts FROM pages),
e AS (SELECT page_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS k FROM s),
t AS (SELECT page_id, k, {_plain("regexp_replace(regexp_replace(part, '(?s)(</p>|</?(?:article|footer|div|ul|table|section|h[1-6])).*$', ''), '(?s)<[^>]*>', '', 'g')")} AS paragraph FROM e)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos, paragraph FROM t WHERE paragraph <> ''"""
)
def page_paragraphs(spark, d):
    p = html.with_page(a.table(spark, d, "pages").select("page_id", "html"), fields=("paragraphs",))
    return p.select("page_id", F.posexplode(html.paragraphs(F.col("page"))).alias("pos", "paragraph"))


@query(
    rf"""WITH s AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS links FROM pages),
e AS (SELECT page_id, url, unnest(links) AS link, generate_subscripts(links, 1) AS k FROM s)
SELECT page_id, CAST(k - 1 AS INTEGER) AS pos, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_plain("regexp_extract(link, 'href=\"([^\"]*)\"', 1)")} AS link_url, {_plain("regexp_extract(link, '(?s)>(.*)</a>', 1)")} AS title FROM e"""
)
def page_links(spark, d):
    p = html.with_page(a.table(spark, d, "pages").select("page_id", "url", "html"), fields=("links",))
    links = p.select("page_id", "url", F.posexplode("page.links").alias("pos", "link"))
    return links.select("page_id", "pos", urls.resolve(F.col("url"), F.col("link.href")).alias("link_url"), text.trim_all(F.col("link.text")).alias("title"))


_TOC = "SELECT l_suppkey AS novel_id, CAST(l_orderkey % 40 + 1 AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS pos, CAST(l_partkey % 60 + 1 AS BIGINT) AS number, l_partkey AS title FROM lineitem WHERE l_orderkey % 40 + 1 <> l_suppkey % 13 + 8"
NEEDED, MOST_PAGES = 57, 9


def _toc(spark, d):
    """Line items as links of paged lists: 40 pages a supplier, one of them missing."""
    line = a.table(spark, d, "lineitem")
    page = (F.col("l_orderkey") % 40 + 1).cast("bigint")
    links = line.select(F.col("l_suppkey").alias("novel_id"), page.alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 60 + 1).cast("bigint").alias("number"), F.col("l_partkey").alias("title"), F.lit("u").alias("url"))
    return links.filter(F.col("page") != F.col("novel_id") % 13 + 8)


@query(
    f"""WITH RECURSIVE toc AS ({_TOC}), by_page AS (SELECT novel_id, page, list(DISTINCT number) AS numbers FROM toc GROUP BY ALL),
walk AS (
    SELECT novel_id, page, numbers AS found, len(numbers) >= {NEEDED} AS over FROM by_page WHERE page = 1
    UNION ALL
    SELECT w.novel_id, b.page, list_distinct(list_concat(w.found, b.numbers)), len(list_distinct(list_concat(w.found, b.numbers))) >= {NEEDED} OR len(list_distinct(list_concat(w.found, b.numbers))) = len(w.found) OR b.page >= {MOST_PAGES}
    FROM walk w JOIN by_page b ON b.novel_id = w.novel_id AND b.page = w.page + 1 WHERE NOT w.over
), ends AS (SELECT novel_id, max(page) AS last FROM walk GROUP BY novel_id)
SELECT novel_id, number, page, pos, title FROM toc JOIN ends USING (novel_id) WHERE page <= last QUALIFY row_number() OVER (PARTITION BY novel_id, number ORDER BY page, pos, title) = 1"""
)
def paged_contents(spark, d):
    """A walk over paged lists with all its stop rules; the SQL takes it step by step."""
    from ..operators.paging import paged_scan

    return paged_scan(_toc(spark, d), MOST_PAGES, NEEDED).drop("url")


_NEWEST = """links AS (
    SELECT l_suppkey AS novel_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn, l_orderkey, l_linenumber FROM lineitem
), paged AS (SELECT *, CAST((rn - 1) // 15 + 1 AS BIGINT) AS page FROM links), kept AS (
    SELECT * FROM paged WHERE NOT (page = 4 AND novel_id % 3 = 0) AND NOT (page = 6 AND rn % 15 > 9 AND novel_id % 5 = 1)
), totals AS (SELECT l_suppkey AS novel_id, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN 40 ELSE count(*) END AS total FROM lineitem GROUP BY l_suppkey)"""


def _newest(spark, d):
    """Line items as lists that begin with the newest, 15 a page, some with an empty or a short page; totals that are right, too low or not known."""
    from pyspark.sql import Window

    line = a.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("novel_id"), "l_orderkey", "l_linenumber")
    rn = F.row_number().over(Window.partitionBy("novel_id").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber")))
    links = line.withColumn("pos", rn).withColumn("page", (F.floor((F.col("pos") - 1) / 15) + 1).cast("bigint"))
    links = links.filter("NOT (page = 4 AND novel_id % 3 = 0) AND NOT (page = 6 AND pos % 15 > 9 AND novel_id % 5 = 1)")
    n = F.col("novel_id")
    totals = line.groupBy("novel_id").agg(F.count("*").alias("n")).select("novel_id", F.when(n % 4 == 0, F.lit(None)).when(n % 7 == 0, 40).otherwise(F.col("n")).alias("total"))
    return links, totals


@query(
    f"""WITH RECURSIVE {_NEWEST}, sizes AS (SELECT novel_id, page, count(*) AS size FROM kept GROUP BY ALL), walk AS (
    SELECT novel_id, page, size AS page_size, size AS through, coalesce(total, 0) > 0 AND size >= total AS over FROM sizes JOIN totals USING (novel_id) WHERE page = 1
    UNION ALL
    SELECT w.novel_id, s.page, w.page_size, w.through + s.size, (coalesce(total, 0) > 0 AND w.through + s.size >= total) OR s.size < w.page_size FROM walk w JOIN sizes s ON s.novel_id = w.novel_id AND s.page = w.page + 1 JOIN totals t ON t.novel_id = w.novel_id WHERE NOT w.over
)
SELECT novel_id, page, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY novel_id ORDER BY rn DESC) AS number FROM kept SEMI JOIN walk USING (novel_id, page)"""
)
def newest_first_contents(spark, d):
    from ..operators.paging import newest_first

    links, totals = _newest(spark, d)
    return newest_first(links, totals).select("novel_id", "page", "l_orderkey", "l_linenumber", "number")


@query(
    f"""WITH {_NEWEST}, w AS (SELECT *, count(*) OVER (PARTITION BY novel_id) AS size FROM kept WHERE page = 1)
SELECT novel_id, l_orderkey, l_linenumber, CAST(greatest(coalesce(total, 0) - size + 1, 1) + size - row_number() OVER (PARTITION BY novel_id ORDER BY rn) AS BIGINT) AS number FROM w JOIN totals USING (novel_id)"""
)
def newest_window_contents(spark, d):
    from ..operators.paging import newest_window

    links, totals = _newest(spark, d)
    return newest_window(links, totals).select("novel_id", "l_orderkey", "l_linenumber", "number")
