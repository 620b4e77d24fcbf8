"""Queries over a whole library made of the supplied tables: orders are novels, line items their chapters, suppliers their sources.

Each applies an operator of the library to all of it, with the SQL that says
what must come out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extraction, json_docs, status, urls
from ..operators import export, gaps, maintenance, paging, reconcile, reports
from ..sources import library as lib_
from ..sources.library import Library
from . import adapters as a
from .catalog import query

NOW = "2002-01-01 00:00:00"


def library(spark, d) -> Library:
    o = a.table(spark, d, "orders")
    l = a.dealt(spark, d, "lineitem", "l_orderkey", ["l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus"])  # noqa: E741
    k = F.col("o_orderkey")
    hint = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "ongoing").otherwise("unknown")
    state = F.when(k % 3 == 0, "backfilling").when(k % 3 == 1, "live").otherwise("likely_complete")
    none = F.lit(None).cast("string")
    novels = o.select(k.alias("id"), F.concat(F.lit("Novel "), k.cast("string")).alias("title"), F.when(k % 4 != 0, F.concat(F.lit("A"), F.col("o_custkey").cast("string"))).alias("author"), none.alias("cover_url"), none.alias("genre"), hint.alias("status_hint"), state.alias("derived_state"), (k % 10 == 0).alias("export_pending"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    n, s = F.col("l_orderkey"), F.col("l_suppkey")
    pairs = l.groupBy(n.alias("novel_id"), s.alias("supp")).agg(F.max("l_linenumber").alias("m")).join(novels.select(F.col("id").alias("novel_id")), "novel_id", "left_semi")
    ranked = Window.partitionBy("novel_id").orderBy("supp")
    sources = pairs.select((F.col("novel_id") * 100000 + F.col("supp")).alias("id"), "novel_id", F.concat(F.lit("site"), (F.col("supp") % 7).cast("string")).alias("source_name"), F.concat(F.lit("https://s"), F.col("supp").cast("string"), F.lit(".example/novel/"), F.col("novel_id").cast("string")).alias("url"), F.row_number().over(ranked).cast("bigint").alias("priority"), F.lit(None).cast("bigint").alias("last_seen_chapter"), F.lit(None).cast("timestamp").alias("last_synced_at"))
    held = l.groupBy(n.alias("novel_id"), F.col("l_linenumber").cast("bigint").alias("number")).agg(F.min(n * 100000 + s).alias("source_id"), F.max("l_shipdate").alias("fetched_at"), F.bool_and(F.col("l_linestatus") == "F").alias("exported"), F.count("*").alias("k"))
    chapters = held.select("novel_id", "number", F.concat(F.lit("Chapter "), F.col("number").cast("string")).alias("title"), F.concat(F.lit("p"), F.col("k").cast("string"), F.lit("\n\nq")).alias("body"), "source_id", "fetched_at", "exported", F.when(F.col("exported"), F.col("fetched_at")).alias("exported_at"))
    missing = gaps.missing(gaps.expected_numbers(chapters), chapters).withColumn("detected_at", F.lit(a.NOW).cast("timestamp"))
    meta = spark.createDataFrame([("k", "v"), ("novels.next_id", "7")], "key string, value string")
    return Library(novels, sources, chapters, missing, meta)


LIB = f"""WITH n AS (SELECT o_orderkey AS id, 'Novel ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'A' || o_custkey END AS author, CAST(NULL AS VARCHAR) AS cover_url, CAST(NULL AS VARCHAR) AS genre,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' ELSE 'unknown' END AS status_hint, CASE o_orderkey % 3 WHEN 0 THEN 'backfilling' WHEN 1 THEN 'live' ELSE 'likely_complete' END AS derived_state, o_orderkey % 10 = 0 AS export_pending, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders),
s AS (SELECT novel_id * 100000 + supp AS id, novel_id, 'site' || (supp % 7) AS source_name, 'https://s' || supp || '.example/novel/' || novel_id AS url, row_number() OVER (PARTITION BY novel_id ORDER BY supp) AS priority FROM (SELECT DISTINCT l_orderkey AS novel_id, l_suppkey AS supp FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey)),
c AS (SELECT l_orderkey AS novel_id, CAST(l_linenumber AS BIGINT) AS number, 'Chapter ' || l_linenumber AS title, 'p' || count(*) || chr(10) || chr(10) || 'q' AS body, min(l_orderkey * 100000 + l_suppkey) AS source_id, max(l_shipdate) AS fetched_at, bool_and(l_linestatus = 'F') AS exported, CASE WHEN bool_and(l_linestatus = 'F') THEN max(l_shipdate) END AS exported_at FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (SELECT novel_id, number FROM (SELECT novel_id, unnest(range(1, max(number) + 1)) AS number FROM c GROUP BY novel_id) ANTI JOIN c USING (novel_id, number))
"""


@query(LIB + "SELECT id, title, author, status_hint, derived_state FROM n UNION ALL SELECT (SELECT greatest(max(id) + 1, 7) FROM n), 'A New One', 'Zed', 'ongoing', 'backfilling'")
def subscribed(spark, d):
    out, _ = maintenance.subscribe(library(spark, d), "A New One", "x", "https://new.example/novel/1", dt.datetime.fromisoformat(NOW), "Zed", status_hint="ongoing")
    return out.novels.select("id", "title", "author", "status_hint", "derived_state")


_LACKING = "(SELECT min(novel_id) FROM g SEMI JOIN n ON id = novel_id)"


@query(LIB + f"SELECT novel_id, url, priority FROM s UNION ALL SELECT {_LACKING}, 'https://new.example/x', (SELECT coalesce(max(priority), 0) + 1 FROM s WHERE novel_id = {_LACKING})")
def added_source(spark, d):
    lib = library(spark, d)
    novel = lib.chapter_gaps.join(lib.novels, F.col("id") == F.col("novel_id"), "left_semi").agg(F.min("novel_id")).first()[0]
    return maintenance.add_source(lib, novel, "new", "https://new.example/x", NOW).sources.select("novel_id", "url", "priority")


@query(LIB + f"SELECT id, CASE WHEN id = {_LACKING} THEN 'backfilling' ELSE derived_state END AS derived_state, CASE WHEN id = {_LACKING} THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM n")
def reopened_by_a_source(spark, d):
    lib = library(spark, d)
    novel = lib.chapter_gaps.join(lib.novels, F.col("id") == F.col("novel_id"), "left_semi").agg(F.min("novel_id")).first()[0]
    return maintenance.add_source(lib, novel, "new", "https://new.example/x", NOW).novels.select("id", "derived_state", "updated_at")


@query(LIB + "SELECT id, CASE WHEN id = (SELECT min(id) FROM s) THEN 'moved' ELSE source_name END AS source_name, CASE WHEN id = (SELECT min(id) FROM s) THEN 'https://moved.example' ELSE url END AS url, priority FROM s")
def repointed_source(spark, d):
    """The first source under another URL; it is found by the one it has."""
    lib = library(spark, d)
    one = lib.sources.orderBy("id").first()
    found = maintenance.resolve_source(lib, one["novel_id"], one["url"])
    return maintenance.repoint_source(lib, found, "moved", "https://moved.example").sources.select("id", "source_name", "url", "priority")


@query(LIB + "SELECT novel_id, number + 1 AS number, title, body, source_id FROM c WHERE (novel_id, number + 1) NOT IN (SELECT (novel_id, number) FROM c)")
def inserted_chapters(spark, d):
    """What is added when every chapter's successor comes in."""
    c = library(spark, d).chapters
    return maintenance.insert_absent(c, c.withColumn("number", F.col("number") + 1))[1].select("novel_id", "number", "title", "body", "source_id")


@query(LIB + "SELECT novel_id, number, CASE WHEN number % 4 = 2 THEN 'new ' || number ELSE title END AS title, CASE WHEN number % 2 = 0 THEN 'fresh' ELSE body END AS body, CASE WHEN number % 2 = 0 THEN number ELSE source_id END AS source_id, exported AND number % 2 <> 0 AS exported, CASE WHEN number % 2 <> 0 THEN exported_at END AS exported_at, fetched_at FROM c")
def replaced_content(spark, d):
    c = library(spark, d).chapters
    n = F.col("number")
    fresh = c.filter(n % 2 == 0).select("novel_id", "number", F.when(n % 4 == 2, F.concat(F.lit("new "), n.cast("string"))).alias("n_title"), F.lit("fresh").alias("n_body"), n.alias("n_source"))
    return reconcile.replace_content(c, fresh).select("novel_id", "number", "title", "body", "source_id", "exported", "exported_at", "fetched_at")


_FETCHED = """f AS (SELECT l_orderkey AS novel_id, l_orderkey * 100000 + l_suppkey AS source_id, CAST(l_linenumber AS BIGINT) AS number, CASE WHEN bool_or(l_returnflag = 'R') THEN 'not_found' ELSE 'ok' END AS outcome, CASE WHEN l_linenumber % 3 = 0 THEN 'Chapter ' || l_linenumber ELSE 'Part ' || l_linenumber END AS title FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linenumber)"""


def _fetched(spark, d):
    l = a.table(spark, d, "lineitem")  # noqa: E741
    n = F.col("l_linenumber")
    seen = l.groupBy(F.col("l_orderkey").alias("novel_id"), (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("source_id"), n.cast("bigint").alias("number")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("gone"))
    return seen.select("novel_id", "source_id", "number", F.when(F.col("gone"), "not_found").otherwise("ok").alias("outcome"), F.concat(F.when(F.col("number") % 3 == 0, "Chapter ").otherwise("Part "), F.col("number").cast("string")).alias("title"))


@query(LIB + f", {_FETCHED}, p AS (SELECT novel_id, min_by(id, priority) AS source_id FROM s GROUP BY novel_id) SELECT novel_id, number, f.title AS n_title FROM f SEMI JOIN p USING (novel_id, source_id) JOIN c USING (novel_id, number) WHERE outcome = 'ok' AND f.title <> c.title")
def retitled(spark, d):
    """Stored chapters whose primary source has another title by now."""
    lib = library(spark, d)
    return maintenance.retitle_pass(lib.chapters, lib.sources, _fetched(spark, d))[1]


@query(LIB + f", v AS (SELECT DISTINCT novel_id, number FROM c WHERE number % 3 = 0) SELECT novel_id, number, TIMESTAMP '{a.NOW}' AS detected_at FROM g UNION ALL SELECT novel_id, number, TIMESTAMP '{NOW}' FROM v ANTI JOIN g USING (novel_id, number)")
def recorded_gaps(spark, d):
    lib = library(spark, d)
    return maintenance.record_gaps(lib.chapter_gaps, lib.chapters.filter("number % 3 = 0").unionByName(lib.chapters.filter("number % 6 = 0")), NOW)


@query(LIB + "SELECT novel_id, number FROM g WHERE number % 2 <> 0")
def cleared_gaps(spark, d):
    g = library(spark, d).chapter_gaps
    return maintenance.clear_gaps(g, g.filter("number % 2 = 0")).select("novel_id", "number")


@query(LIB + f", {_FETCHED}, t AS (SELECT source_id AS id, max(number) AS top FROM f WHERE outcome = 'ok' GROUP BY ALL) SELECT id, top AS last_seen_chapter, CASE WHEN top IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_synced_at FROM s LEFT JOIN t USING (id)")
def source_progress(spark, d):
    return reconcile.source_progress(library(spark, d).sources, _fetched(spark, d).filter("outcome = 'ok'"), NOW).select("id", "last_seen_chapter", "last_synced_at")


@query(LIB + f"SELECT id, title, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'B' || id END ELSE author END AS author, CASE WHEN id % 3 = 0 THEN 'c' || id END AS cover_url, CASE WHEN id % 3 = 0 THEN 'completed' ELSE status_hint END AS status_hint, CASE WHEN id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM n")
def refreshed_metadata(spark, d):
    n = library(spark, d).novels
    k = F.col("id")
    meta = n.filter(k % 3 == 0).select(k.alias("novel_id"), F.when(k % 2 == 0, F.concat(F.lit("B"), k.cast("string"))).alias("author"), F.concat(F.lit("c"), k.cast("string")).alias("cover_url"), F.lit(None).cast("string").alias("genre"), F.lit("completed").alias("status_hint"))
    return maintenance.refresh_metadata(n, meta, NOW)[0].select("id", "title", "author", "cover_url", "status_hint", "updated_at")


@query(LIB + f"SELECT novel_id, number, exported OR novel_id % 5 = 0 AS exported, CASE WHEN novel_id % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE exported_at END AS exported_at FROM c")
def exported_marks(spark, d):
    lib = library(spark, d)
    return maintenance.mark_exported(lib.chapters, lib.chapters.filter("novel_id % 5 = 0").select("novel_id"), NOW).select("novel_id", "number", "exported", "exported_at")


@query(LIB + "SELECT 'novels' AS tab, count(*) AS n FROM n WHERE id <> 1 UNION ALL SELECT 'sources', count(*) FROM s WHERE novel_id <> 1 UNION ALL SELECT 'chapters', count(*) FROM c WHERE novel_id <> 1 UNION ALL SELECT 'chapter_gaps', count(*) FROM g WHERE novel_id <> 1")
def unsubscribed(spark, d):
    out, rows = maintenance.unsubscribe(library(spark, d), 1), None
    for t in ("novels", "sources", "chapters", "chapter_gaps"):
        one = getattr(out, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(LIB + "SELECT 'k' AS key, 'w' AS value UNION ALL SELECT 'novels.next_id', '7' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM c")
def meta_upserts(spark, d):
    lib = library(spark, d)
    return lib_.meta_set(lib_.meta_set(lib, "k", "w"), "rows", str(lib.chapters.count())).meta


@query(LIB + "SELECT id, title FROM n WHERE id = 12 UNION ALL SELECT id, title FROM n WHERE lower(title) = 'novel 7'")
def novel_lookup(spark, d):
    n = library(spark, d).novels
    return lib_.select_novel(n, "12").unionByName(lib_.select_novel(n, "nOVEL 7")).select("id", "title")


@query(LIB + "SELECT novel_id, number, title, replace(body, chr(10) || chr(10), '|') AS paragraphs FROM c WHERE novel_id = 3 UNION ALL SELECT novel_id, number, title, replace(body, chr(10) || chr(10), '|') FROM c WHERE novel_id = 4 AND number = 2")
def loaded_chapters(spark, d):
    lib = library(spark, d)
    return lib_.chapters_of(lib, 3).unionByName(lib_.chapters_of(lib, 4, 2)).select("novel_id", "number", "title", F.array_join("paragraphs", "|").alias("paragraphs"))


@query(LIB + "SELECT url, id AS source_id FROM s WHERE priority = 1 UNION ALL SELECT url || '?', NULL FROM s WHERE priority = 2")
def sources_by_url(spark, d):
    s = library(spark, d).sources
    asked = s.filter("priority = 1").select("url").unionByName(s.filter("priority = 2").select(F.concat("url", F.lit("?")).alias("url")))
    return lib_.source_ids(s, asked)


@query(LIB + "SELECT id, title, author, status_hint, coalesce((SELECT min_by(url, priority) FROM s WHERE novel_id = n.id), '') AS source_url FROM n")
def novel_metadata(spark, d):
    lib = library(spark, d)
    return lib_.novel_meta(lib.novels, lib.sources).select("id", "title", "author", "status_hint", "source_url")


@query(LIB + "SELECT novel_id, count(*) AS n, min(number) AS first_number, max(number) AS last_number, 'Chapter ' || min(number) AS first_title, 'Chapter ' || max(number) AS last_title FROM c GROUP BY novel_id")
def list_ends(spark, d):
    c = library(spark, d).chapters
    return reports.list_ends(c.select("novel_id", F.lit(1).alias("source_id"), "number", F.col("number").alias("pos"), "title")).drop("source_id")


@query(
    LIB
    + """, k AS (SELECT novel_id, count(*) AS k FROM c GROUP BY ALL), o AS (SELECT novel_id, count(*) AS m, string_agg(number, ', ' ORDER BY number) AS l FROM g GROUP BY ALL)
SELECT id AS novel_id, '#' || id || ' ' || title || ' — ' || coalesce(k, 0) || ' chapters [' || derived_state || CASE WHEN export_pending THEN ', export pending' ELSE '' END || ']' AS line, 'gaps: ' || l AS gap_line FROM n LEFT JOIN k ON k.novel_id = id LEFT JOIN o ON o.novel_id = id"""
)
def status_report(spark, d):
    lib = library(spark, d)
    return reports.status_lines(lib.novels, lib.sources, lib.chapters, lib.chapter_gaps)


@query(LIB + "SELECT DISTINCT novel_id FROM g SEMI JOIN n ON id = novel_id")
def subs_with_gaps(spark, d):
    lib = library(spark, d)
    return reports.subscription_lines(lib.novels, lib.sources, lib.chapters, lib.chapter_gaps, gaps_only=True).filter("gap_line IS NOT NULL").select("novel_id")


@query(
    LIB
    + """, r AS (SELECT DISTINCT l_orderkey AS novel_id, CAST(l_partkey % 9 + 1 AS BIGINT) AS number FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY number) - 1 AS i, count(*) OVER (PARTITION BY novel_id) AS k FROM c SEMI JOIN r USING (novel_id, number)),
m AS (SELECT novel_id, min(number) AS f, max(number) AS l, max(number) FILTER (WHERE i = k // 2) AS mid, count(*) AS k FROM b GROUP BY ALL), t AS (SELECT novel_id, count(*) AS n, max(number) AS last FROM c GROUP BY ALL), u AS (SELECT novel_id, max(number) AS last FROM r GROUP BY ALL)
SELECT novel_id, n AS n_stored, coalesce(k, 0) AS n_common, n - coalesce(k, 0) AS n_only_stored, t.last AS stored_last, u.last AS remote_last, CASE WHEN k > 0 THEN f || ', ' || mid || ', ' || l END AS samples FROM t JOIN u USING (novel_id) LEFT JOIN m USING (novel_id)"""
)
def remote_samples(spark, d):
    """Stored chapters against a remote list, with the three numbers that are compared."""
    remote = a.dealt(spark, d, "lineitem", "l_orderkey", ["l_orderkey", "l_partkey"]).select(F.col("l_orderkey").alias("novel_id"), (F.col("l_partkey") % 9 + 1).alias("number"))
    return reports.stored_against_remote(library(spark, d).chapters, remote).withColumn("samples", F.array_join("samples", ", "))


@query(LIB + "SELECT novel_id, number FROM g ANTI JOIN (SELECT novel_id, number + 1 AS number FROM c) USING (novel_id, number)")
def surfaced_gaps(spark, d):
    """Recorded gaps that a pass which brings every chapter's successor leaves open."""
    lib = library(spark, d)
    now = maintenance.insert_absent(lib.chapters, lib.chapters.withColumn("number", F.col("number") + 1))[0]
    return gaps.unfilled_gaps(lib.chapter_gaps, now).select("novel_id", "number")


_SEEN = "SELECT user_id AS novel_id, 1 AS source_id, event_id AS pos, CAST(floor(value) AS BIGINT) % 50 AS number, event_type AS title FROM events"


@query(
    f"WITH e AS ({_SEEN}), f AS (SELECT novel_id, number, min_by(title, pos) AS first_title, max_by(title, pos) AS last_title FROM e GROUP BY ALL) SELECT * FROM f"
)
def kept_duplicates(spark, d):
    """Of rows with one number: the first, as a page's scan keeps it, and the last, as a map that is filled in order."""
    e = a.table(spark, d, "events").select(F.col("user_id").alias("novel_id"), F.lit(1).alias("source_id"), F.col("event_id").alias("pos"), (F.floor("value").cast("bigint") % 50).alias("number"), F.col("event_type").alias("title"))
    first = gaps.dedupe(e, last=False).select("novel_id", "number", F.col("title").alias("first_title"))
    return first.join(gaps.dedupe(e, last=True).select("novel_id", "number", F.col("title").alias("last_title")), ["novel_id", "number"])


@query(f"WITH e AS ({_SEEN}) SELECT novel_id, number, pos, title FROM (SELECT DISTINCT ON (novel_id, number) * FROM e ORDER BY novel_id, number, pos // 100, pos) QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY number DESC) <= 5")
def newest_entries(spark, d):
    """The five highest numbers of each list, of equal ones the first to arrive."""
    e = a.table(spark, d, "events").select(F.col("user_id").alias("novel_id"), F.floor(F.col("event_id") / 100).alias("offset"), F.col("event_id").alias("pos"), (F.floor("value").cast("bigint") % 50).alias("number"), F.col("event_type").alias("title"))
    return gaps.newest(paging.arrived(e).withColumn("source_id", F.lit(1)), 5).select("novel_id", "number", "pos", "title")


@query("SELECT c_custkey AS novel_id, CAST(k AS BIGINT) AS number, 'https://x.org/novel/' || c_custkey || '/chapter-' || k AS url FROM (SELECT c_custkey, unnest(range(1, c_nationkey + 1)) AS k FROM customer)")
def generated_chapters(spark, d):
    c = a.table(spark, d, "customer").select(F.col("c_custkey").alias("novel_id"), F.col("c_nationkey").alias("n"))
    return gaps.generated(c, lambda k: urls.read_url("https://x.org/", F.col("novel_id").cast("string"), k))


@query("SELECT event_id AS pos, event_type AS value FROM events ORDER BY event_id DESC LIMIT 8")
def log_tail(spark, d):
    return lib_.log_tail(a.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("value")))


@query("SELECT event_id AS pos, event_type AS value FROM events WHERE contains(event_type, 'err') ORDER BY event_id DESC LIMIT 1")
def last_log_line(spark, d):
    return lib_.last_sync_line(a.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("value")), "err")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) < 900")
def short_texts(spark, d):
    docs = a.table(spark, d, "documents").filter(F.char_length("text") < 900)
    return docs.select("doc_id", F.char_length("text").cast("bigint").alias("n"))


CODES = "CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 403 WHEN 5 THEN 500 ELSE 200 END"


@query(
    f"WITH e AS (SELECT event_id, {CODES} AS code, event_id % 20 AS attempt FROM events) SELECT event_id, CASE WHEN code = 200 THEN 'ok' WHEN code IN (404, 410) THEN 'not_found' ELSE 'error' END AS outcome, code IN (429, 500, 502, 503, 504) AS again, CAST(least(30000, 1000 * 2 ** least(attempt + 1, 16)) AS BIGINT) AS pause_ms FROM e"
)
def fetch_outcomes(spark, d):
    code = F.expr(CODES)
    return a.table(spark, d, "events").select("event_id", status.outcome(code).alias("outcome"), status.is_retryable(code).alias("again"), status.backoff_ms((F.col("event_id") % 20).cast("int"), 1000, 30_000).cast("bigint").alias("pause_ms"))


@query(
    "WITH l AS (SELECT o_orderkey, [o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN ' Active' WHEN 1 THEN 'hiatus' ELSE 'x' END, CASE o_orderkey % 2 WHEN 0 THEN 'COMPLETE' ELSE '' END] AS ls FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ongoing' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'unknown' END AS hint FROM l"
)
def first_known_labels(spark, d):
    k = F.col("o_orderkey")
    labels = F.array("o_orderpriority", F.when(k % 3 == 0, " Active").when(k % 3 == 1, "hiatus").otherwise("x"), F.when(k % 2 == 0, "COMPLETE").otherwise(""))
    return a.table(spark, d, "orders").select("o_orderkey", status.first_known(labels).alias("hint"))


@query(
    LIB
    + """, l AS (SELECT novel_id, list(number ORDER BY number) AS ns FROM g GROUP BY ALL), p AS (SELECT novel_id, min_by(url, priority) AS url FROM s GROUP BY ALL)
SELECT novel_id, len(ns) || CASE WHEN len(ns) = 1 THEN ' chapter ' ELSE ' chapters ' END AS head, regexp_extract(url, '//([^/]+)', 1) AS host, array_to_string(ns, ', ') AS listed FROM l JOIN p USING (novel_id)"""
)
def gap_notices(spark, d):
    """The notice of each novel's gaps, taken apart again."""
    lib = library(spark, d)
    first = lib.sources.groupBy("novel_id").agg(F.min_by("url", "priority").alias("url"))
    notes = lib.chapter_gaps.groupBy("novel_id").agg(F.collect_set("number").alias("numbers")).join(first, "novel_id")
    page = export.gap_notice(F.col("numbers"), F.col("url"))
    part = lambda pattern: F.regexp_extract(page, pattern, 1)
    return notes.select("novel_id", part("volume: ([0-9]+ chapters? )").alias("head"), part("read from ([^<]*)[.]</p>").alias("host"), part("By number: ([^<]*)</p>").alias("listed"))


@query(
    """SELECT p_partkey, 'https://x.org/novel/' || lower(replace(p_name, ' ', '-')) AS page, 'https://s' || p_size || '.example/wp-admin/admin-ajax.php' AS ajax, 'action=wi_getreleases_pagination&pagenum=' || p_size || '&mypostid=' || p_partkey AS form, replace(replace(p_name, '#', '%23'), ' ', '+') AS asked,
strftime(TIMESTAMP '2001-02-03 04:05:06' + to_seconds(CAST(p_partkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS at FROM part"""
)
def built_addresses(spark, d):
    p = a.table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    form = urls.list_request(F.concat(F.lit("https://s"), size.cast("string"), F.lit(".example/series/1")), size, key.cast("string"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2001-02-03 04:05:06")) + key)
    return p.select("p_partkey", urls.canonical_url("https://x.org/", F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("page"), form["url"].alias("ajax"), form["body"].alias("form"), urls.query_value(F.col("p_name")).alias("asked"), reports.timestamp_text(at).alias("at"))


@query(
    """SELECT p_partkey, nullif(trim(p_name), '') AS title, CASE p_partkey % 3 WHEN 0 THEN 'W' || p_size WHEN 1 THEN 'E' || p_size END AS author, CASE WHEN p_partkey % 2 = 0 THEN 'https://i.example/' || p_partkey END AS cover_url,
CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE p_brand || ', ' || p_type END AS genre, CASE p_size % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'ongoing' ELSE 'unknown' END AS status_hint FROM part"""
)
def novel_documents(spark, d):
    """Novels as an API's documents, read back."""
    k = F.col("p_partkey")
    person = lambda c, role: F.struct(F.concat(F.lit(c), F.col("p_size").cast("string")).alias("name"), F.lit(role).alias("role"))
    authors = F.when(k % 3 == 0, F.array(person("E", "editor"), person("W", "author"))).when(k % 3 == 1, F.array(person("E", "editor"), person("T", "translator")))
    name = lambda c: F.struct(c.alias("name"))
    genres = F.when(k % 4 == 1, F.array(name(F.lit("  ")), name(F.col("p_type")))).when(k % 4 > 1, F.array(name(F.col("p_brand")), name(F.concat(F.lit(" "), F.col("p_type")))))
    label = F.when(F.col("p_size") % 3 == 0, "Finished").when(F.col("p_size") % 3 == 1, "releasing").otherwise("hiatus")
    doc = F.to_json(F.struct(F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("title"), label.alias("status"), F.when(k % 2 == 0, F.concat(F.lit("https://i.example/"), k.cast("string"))).otherwise("").alias("cover"), genres.alias("genres"), authors.alias("authors")))
    return a.table(spark, d, "part").select("p_partkey", doc.alias("doc")).select("p_partkey", json_docs.novel_document(F.col("doc")).alias("n")).select("p_partkey", "n.*")


@query(
    """WITH p AS (SELECT o_orderkey, list(struct_pack(number := CAST(l_linenumber AS BIGINT), title := CASE WHEN l_suppkey % 3 = 0 THEN 'Chapter ' || l_linenumber ELSE 'T' || l_suppkey END) ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_suppkey % 5 <> 0) AS chapters, count(*) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(array_to_string(list_transform(chapters, lambda x: x.number || ' ' || x.title), ', '), '') AS chapters, CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE k END AS total FROM p"""
)
def chapter_pages(spark, d):
    """Pages of an API's chapter list; fractional numbers are dropped, a missing total is the page's length."""
    l = a.table(spark, d, "lineitem").join(a.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")  # noqa: E741
    number = F.col("l_linenumber").cast("double") + F.when(F.col("l_suppkey") % 5 == 0, 0.5).otherwise(0.0)
    title = F.when(F.col("l_suppkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string"), F.lit(": T"), F.col("l_suppkey").cast("string")))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(number.alias("number"), title.alias("title")).alias("i"))
    page = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    doc = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct("items", F.lit(1000).alias("total")))).otherwise(F.to_json(F.struct("items")))
    return page.select("o_orderkey", doc.alias("doc")).select("o_orderkey", json_docs.chapter_page(F.col("doc")).alias("p")).select("o_orderkey", F.array_join(F.transform("p.chapters", lambda c: F.concat_ws(" ", c["number"].cast("string"), c["title"])), ", ").alias("chapters"), "p.total")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 3 OR coalesce(trim(text), '') = '' THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN turn % 2 = 0 THEN turn + 1 ELSE 77 END AS number, CASE WHEN turn % 5 = 3 THEN 'locked' WHEN coalesce(trim(text), '') = '' THEN 'no body' END AS message,
CASE WHEN turn % 5 <> 3 AND coalesce(trim(text), '') <> '' THEN array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) END AS joined FROM conversations"""
)
def chapter_documents(spark, d):
    """Every turn as a chapter's document: locked ones and those without a body are errors, a number that is none is the list's."""
    turn = F.col("turn")
    doc = F.to_json(F.struct(F.when(turn % 2 == 0, turn + 1.0).otherwise(turn + 0.5).alias("number"), F.col("role").alias("title"), F.col("text").alias("body"), F.when(turn % 5 == 3, F.lit(True)).alias("locked")))
    read = a.table(spark, d, "conversations").select("conv_id", "turn", doc.alias("doc")).select("conv_id", "turn", json_docs.chapter_document(F.col("doc"), F.lit(77).cast("bigint")).alias("c"))
    return read.select("conv_id", "turn", "c.outcome", "c.number", "c.message", F.array_join("c.paragraphs", "\n").alias("joined"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 's' || p_partkey END AS slug FROM part"""
)
def search_slugs(spark, d):
    """The first hit with the same title, in a bare list or an envelope."""
    k = F.col("p_partkey")
    hit = lambda s, t: F.struct(s.alias("slug"), t.alias("title"))
    other = F.concat("p_name", F.lit(" and more"))
    right = F.when(k % 3 == 2, other).otherwise(F.concat(F.upper("p_name"), F.lit("!")))
    hits = F.array(hit(F.lit("other"), other), hit(F.concat(F.lit("s"), k.cast("string")), right), hit(F.lit("late"), right))
    doc = F.when(k % 2 == 0, F.to_json(hits)).otherwise(F.to_json(F.struct(hits.alias("items"))))
    return a.table(spark, d, "part").select("p_partkey", "p_name", doc.alias("doc")).select("p_partkey", json_docs.slug_by_title(F.col("doc"), F.col("p_name")).alias("slug"))


_SITE_PAGE = """CASE p_partkey % 5
WHEN 0 THEN '<meta property="og:title" content="' || p_name || '"><meta name="twitter:creator" content="' || p_brand || '"><span class="label">' || p_type || '</span><span class="label">Completed</span>'
WHEN 1 THEN '<title>' || p_name || ' | site</title><a href="/profile/' || p_size || '">' || p_brand || '</a><span class="label">hiatus</span>'
WHEN 2 THEN '<meta property="og:title" content="' || p_name || '"><a href="https://x/profile/1">' || p_brand || '</a><meta property="og:image" content="' || CASE WHEN p_size % 2 = 0 THEN 'noimagefound' ELSE 'i' || p_size END || '"><span class="rnd_stats">ongoing</span><span class="cnt_toc">(' || p_size || ')</span><input id="mypostid" value=" ' || p_partkey || '">'
WHEN 3 THEN '<meta property="og:title" content="x by y - ' || p_size || ' Chapters"><h1 class="novel-title"> ' || p_name || '</h1><p class="novel-author">Author: <b>' || p_brand || '</b></p><i class="status-badge">finished</i><h1 class="chapter-title">Chapter ' || p_size || ' - ' || p_size || ': ' || p_type || '</h1>'
ELSE '<meta property="og:novel:novel_name" content="' || p_name || '"><meta property="og:novel:author" content="' || p_brand || '"><meta property="og:novel:status" content="1"><div data-total-chapters="' || p_size || '"></div>' END"""
_SITE_HOST = "CASE p_partkey % 5 WHEN 0 THEN 'www.royalroad.com' WHEN 1 THEN 'RoyalRoad.com' WHEN 2 THEN 'scribblehub.com' WHEN 3 THEN 'www.lightnovelworld.org' ELSE 'freewebnovel.com' END"


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN 'scribblehub' WHEN 3 THEN 'lightnovelworld' WHEN 4 THEN 'freewebnovel' ELSE 'royalroad' END AS profile, p_name AS title, p_brand AS author, CASE WHEN p_partkey % 5 = 2 AND p_size % 2 <> 0 THEN 'i' || p_size END AS cover_url,
CASE p_partkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'unknown' WHEN 3 THEN 'completed' ELSE 'ongoing' END AS status_hint, CASE WHEN p_partkey % 5 >= 2 THEN CAST(p_size AS BIGINT) END AS total, CASE WHEN p_partkey % 5 = 2 THEN CAST(p_partkey AS VARCHAR) END AS post_id, CASE WHEN p_partkey % 5 = 3 THEN p_type END AS chapter_title FROM part"""
)
def site_variants(spark, d):
    """Landing pages of the known sites' kinds, read by the profile of their host."""
    pages = a.table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://"), F.expr(_SITE_HOST), F.lit("/novel/1")).alias("url"), F.expr(_SITE_PAGE).alias("html"))
    found = extraction.extract(extraction.with_profile(pages, extraction.site_profiles(spark)), extraction.site_rules(spark))
    return found.select("p_partkey", "profile", "title", "author", "cover_url", "status_hint", "total", "post_id", "chapter_title")


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') = 'thther.example.org' AS there FROM pages")
def host_filter(spark, d):
    u = F.col("url")
    return a.table(spark, d, "pages").select("page_id", urls.bare_host(u).alias("host"), urls.on_host(u, "ThTher.Example.org").alias("there"))
