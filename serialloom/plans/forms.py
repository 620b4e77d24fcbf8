"""Queries over the scalar functions: each turns a whole table into the texts that a function is for, with the SQL that says the same.

The texts are made by expressions that Spark and DuckDB read alike, from keys
and names of the supplied tables, so that each rule meets every form it knows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_docs, status, text
from . import adapters as a
from .catalog import query

TITLES = """CASE p_partkey % 9 WHEN 0 THEN 'Chapter ' || p_partkey || ': ' || p_name WHEN 1 THEN '  chapter' || p_partkey || ' - ' || p_name || ' '
WHEN 2 THEN 'Chapter ' || p_partkey WHEN 3 THEN p_partkey || ': ' || p_name WHEN 4 THEN p_partkey || '.' || p_name
WHEN 5 THEN 'CHAPTER ' || p_partkey || '- ' || p_partkey || ': ' || p_name WHEN 6 THEN p_name WHEN 7 THEN p_partkey || ' :' END"""
CLEAN = "coalesce(nullif(trim(regexp_replace(trim(t), '(?i)^chapter *[0-9]+ *[-:|–—]?', '')), ''), trim(t))"


@query(
    rf"""WITH s AS (SELECT p_partkey, {TITLES} AS t FROM part), b AS (SELECT *, trim(regexp_replace(trim(t), '(?i)^chapter \s*', '')) AS bare FROM s)
SELECT p_partkey, {CLEAN} AS cleaned, coalesce(nullif(trim(regexp_replace(coalesce({CLEAN}, ''), '^\s*[0-9]+\s*:', '')), ''), 'Chapter ' || p_partkey) AS displayed,
coalesce(nullif(trim(regexp_extract(trim(t), '(?s)^[0-9]+\s*[.:](.+)$', 1)), ''), trim(t)) AS numbered,
coalesce(nullif(trim(regexp_extract(bare, '(?s)^[0-9]+\s*[.:-](.*)$', 1)), ''), bare) AS marked FROM b"""
)
def chapter_title_forms(spark, d):
    t = F.expr(TITLES)
    return a.table(spark, d, "part").select(
        "p_partkey",
        text.clean_chapter_title(t).alias("cleaned"),
        text.display_title(t, F.col("p_partkey")).alias("displayed"),
        text.strip_number_mark(t).alias("numbered"),
        text.strip_chapter_mark(t).alias("marked"),
    )


HEADS = """CASE p_partkey % 4 WHEN 0 THEN p_brand || ' - Chapter ' || p_size || ': ' || p_name || ' | Free Web Novel' WHEN 1 THEN p_name || ' | ' || p_brand
WHEN 2 THEN ' ' || p_brand || ' - Chapter ' || p_size || ' |free web novel ' ELSE p_name END"""


@query(
    rf"""WITH s AS (SELECT p_partkey, {HEADS} AS h FROM part), b AS (SELECT *, regexp_replace(h, '\s*\|\s*(?i:free web novel)\s*$', '') AS bare, regexp_replace(trim(h), '\s*\|\s*(?i:free web novel)\s*$', '') AS tidy FROM s),
c AS (SELECT *, CASE WHEN strpos(tidy, ' - Chapter ') > 0 THEN substr(tidy, strpos(tidy, ' - Chapter ') + 3) ELSE tidy END AS t FROM b)
SELECT p_partkey, bare, nullif({CLEAN}, '') AS title, trim(regexp_replace(h, '\|[^|]*$', '')) AS head FROM c"""
)
def page_title_forms(spark, d):
    h = F.expr(HEADS)
    return a.table(spark, d, "part").select("p_partkey", text.strip_site_suffix(h).alias("bare"), text.page_chapter_title(h).alias("title"), text.head_before_bar(h).alias("head"))


COUNTS = """CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || ' - ' || o_custkey || ' chapters' WHEN 1 THEN 'Chapters: ' || o_custkey WHEN 2 THEN o_orderstatus || ':' || o_orderpriority || ': 1,' || o_custkey ELSE '' END"""


@query(
    rf"""WITH s AS (SELECT o_orderkey, {COUNTS} AS t FROM orders)
SELECT o_orderkey, TRY_CAST(string_split_regex(trim(string_split(t, ' - ')[-1]), '\s+')[1] AS BIGINT) AS tail, TRY_CAST(regexp_replace(t, '[^0-9]', '', 'g') AS BIGINT) AS digits,
trim(regexp_replace(t, '(?s)^[^:]*:', '')) AS behind FROM s"""
)
def counts_from_text(spark, d):
    t = F.expr(COUNTS)
    return a.table(spark, d, "orders").select("o_orderkey", text.count_in_tail(t).alias("tail"), text.digits_only(t).alias("digits"), text.after_colon(t).alias("behind"))


MIMES = "CASE p_partkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'IMAGE/GIF; q=1' WHEN 2 THEN ' image/webp' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'text/html' END"
COVERS = "CASE WHEN p_partkey % 3 = 0 THEN 'https://img.example/noimagefound.jpg' ELSE 'https://img.example/' || p_partkey || '.png' END"


@query(
    f"""WITH s AS (SELECT p_partkey, p_name || ' <' || p_brand || '> & ' || p_type AS name, lower(trim(string_split({MIMES}, ';')[1])) AS kind, {COVERS} AS url FROM part)
SELECT p_partkey, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
CASE WHEN starts_with(kind, 'image/') THEN 'cover.' || CASE kind WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' WHEN 'image/webp' THEN 'webp' ELSE 'jpg' END END AS cover,
CASE WHEN NOT contains(url, 'noimagefound') THEN url END AS cover_url FROM s"""
)
def book_assets(spark, d):
    name = F.expr("p_name || ' <' || p_brand || '> & ' || p_type")
    return a.table(spark, d, "part").select("p_partkey", text.xml_escape(name).alias("escaped"), text.cover_filename(F.expr(MIMES)).alias("cover"), text.real_cover(F.expr(COVERS)).alias("cover_url"))


NUMBERS = "CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN floor(value) WHEN 2 THEN 0 - value ELSE CAST(event_id AS DOUBLE) * 10000000 END"


@query(f"WITH s AS (SELECT event_id, {NUMBERS} AS n FROM events) SELECT event_id, CASE WHEN n >= 1 AND n <= 4294967295 AND n = floor(n) THEN CAST(n AS BIGINT) END AS number FROM s")
def valid_numbers(spark, d):
    return a.table(spark, d, "events").select("event_id", json_docs.whole_number(F.expr(NUMBERS).cast("double")).alias("number"))


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL) SELECT doc_id, substr(parts[1], 1, 90) AS opening, len(parts) AS n_parts FROM s")
def document_openings(spark, d):
    """How each document begins, and its paragraphs."""
    parts = text.split_body(F.col("text"))
    return a.table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.preview(parts).alias("opening"), F.size(parts).cast("long").alias("n_parts"))


HEADERS = "CASE event_id % 4 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN 'Wed, 21 Oct 2015' WHEN 2 THEN '' ELSE CAST(user_id AS VARCHAR(20)) END"


@query(f"SELECT event_id, TRY_CAST(nullif(regexp_extract(trim({HEADERS}), '^[0-9]+$', 0), '') AS BIGINT) AS seconds FROM events")
def retry_headers(spark, d):
    return a.table(spark, d, "events").select("event_id", status.retry_after(F.expr(HEADERS)).alias("seconds"))


LISTS = """'[{"title":"a' || o_orderkey || '","url":"/c/1","visible":' || (o_orderkey % 2) || '},{"title":"b' || o_custkey || '","url":"/c/2"},{"title":"c","url":"/c/3","visible":' || (o_custkey % 3) || '}]'"""


@query(
    f"""WITH s AS (SELECT o_orderkey, from_json({LISTS}, '[{{"title":"VARCHAR","url":"VARCHAR","visible":"INTEGER"}}]') AS l FROM orders),
e AS (SELECT o_orderkey, unnest(list_filter(l, lambda x: coalesce(x.visible, 1) <> 0)) AS x, generate_subscripts(list_filter(l, lambda x: coalesce(x.visible, 1) <> 0), 1) AS number FROM s)
SELECT o_orderkey, CAST(number AS BIGINT) AS number, x.title AS title, x.url AS url FROM e"""
)
def visible_positions(spark, d):
    """Entries of an embedded list, numbered among those that are not hidden."""
    rows = a.table(spark, d, "orders").select("o_orderkey", F.posexplode(json_docs.visible_entries(F.expr(LISTS))).alias("pos", "x"))
    return rows.select("o_orderkey", (F.col("pos") + 1).cast("long").alias("number"), "x.title", "x.url")
