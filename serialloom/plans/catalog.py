"""The catalogue: each query applies the engine's operators to the supplied tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..functions.status import status_hint
from ..operators import export, gaps, lifecycle, maintenance, reconcile, reports
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _gaps(spark, d):
    have = a.held_numbers(spark, d)
    return gaps.missing(gaps.expected_numbers(have), have)


@query(f"WITH {a.GAPS} SELECT novel_id, number FROM gaps")
def library_gaps(spark, d):
    return _gaps(spark, d)


@query(
    f"""WITH {a.GAPS}
SELECT novel_id, count(*) AS n_gaps, array_to_string(list_sort(list(number))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', … (+' || (count(*) - 3) || ' more)' ELSE '' END AS listed FROM gaps GROUP BY novel_id"""
)
def gap_summary(spark, d):
    return reports.gap_summary(_gaps(spark, d), 3)


@query(f"WITH {a.GAPS} SELECT novel_id, number FROM gaps QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY number) <= 2")
def missing_limited(spark, d):
    return gaps.first_missing(_gaps(spark, d), 2)


@query(f"WITH {a.PICK} SELECT novel_id, number, source_id, priority FROM pick")
def ranked_pick(spark, d):
    return reconcile.ranked_pick(a.candidates(spark, d)).select("novel_id", "number", "source_id", "priority")


@query(f"WITH {a.PICK} SELECT novel_id, count(*) AS newly_fetched, count(*) FILTER (WHERE priority <> 1) AS from_fallback FROM pick GROUP BY novel_id")
def fallback_filled(spark, d):
    won = reconcile.ranked_pick(a.candidates(spark, d))
    return won.groupBy("novel_id").agg(F.count("*").alias("newly_fetched"), F.count_if(F.col("priority") != 1).alias("from_fallback"))


@query(
    f"""WITH {a.CAND}, walk AS (
    SELECT novel_id, number, min(priority) FILTER (WHERE outcome = 'ok') AS ok_rank, bool_or(priority = 1 AND outcome = 'not_found') AS p404 FROM cand GROUP BY ALL
) SELECT novel_id, number, ok_rank FROM walk WHERE p404"""
)
def primary_holes(spark, d):
    return reconcile.attempts(a.candidates(spark, d)).filter("primary_404 AND NOT primary_ok").select("novel_id", "number", "ok_rank")


@query(
    f"""WITH {a.CAND}, walk AS (
    SELECT novel_id, number, min(priority) FILTER (WHERE outcome = 'ok') AS ok_rank, bool_or(priority = 1 AND outcome = 'not_found') AS p404 FROM cand GROUP BY ALL
) SELECT novel_id, number FROM walk WHERE ok_rank IS NULL AND NOT coalesce(p404, FALSE)"""
)
def transient_failures(spark, d):
    return reconcile.attempts(a.candidates(spark, d)).filter("ok_rank IS NULL AND NOT primary_404").select("novel_id", "number")


@query(
    f"""WITH {a.CAND}, held AS (
    SELECT novel_id, number, max(source_id) AS source_id FROM cand GROUP BY ALL
), primaries AS (SELECT novel_id, number, source_id AS primary_id FROM cand WHERE priority = 1 AND outcome = 'ok')
SELECT held.novel_id, held.number, source_id, primary_id FROM held JOIN primaries USING (novel_id, number) WHERE source_id IS DISTINCT FROM primary_id"""
)
def upgrade_candidates(spark, d):
    cand = a.candidates(spark, d)
    held = cand.groupBy("novel_id", "number").agg(F.max("source_id").alias("source_id"))
    offers = cand.filter("priority = 1 AND outcome = 'ok'")
    marked = cand.filter("priority = 1 AND outcome <> 'ok'").select("novel_id", "number")
    return reconcile.upgrade_candidates(held, marked, offers).select("novel_id", "number", "source_id", "primary_id")


@query(
    f"""WITH {a.CAND}, ends AS (SELECT novel_id, source_id, priority, max(number) AS top FROM cand GROUP BY ALL)
SELECT novel_id, max(top) AS hi, min(top) AS lo, string_agg(source_id || '=' || top, ', ' ORDER BY priority) AS detail FROM ends GROUP BY novel_id HAVING count(*) > 1 AND max(top) <> min(top)"""
)
def source_divergence(spark, d):
    return reconcile.divergence(a.candidates(spark, d))


@query(
    f"""WITH {a.OBS}, top AS (SELECT novel_id, max(number) AS max_have FROM obs WHERE exported GROUP BY novel_id), met AS (
    SELECT obs.novel_id, number, coalesce(max_have, 0) AS max_have FROM obs LEFT JOIN top USING (novel_id)
), agg AS (SELECT novel_id, max(max_have) AS max_have, min(number) FILTER (WHERE number > max_have) AS min_new FROM met GROUP BY novel_id)
SELECT novel_id, max_have, min_new, coalesce(min_new <= max_have + 1, TRUE) AS contiguous FROM agg"""
)
def delta_contiguity(spark, d):
    seen = a.observations(spark, d)
    return gaps.contiguity(seen.filter("exported"), seen)


@query(
    f"""WITH {a.NOVELS}, {a.OBS}, latest AS (SELECT novel_id, max(fetched_at) AS latest FROM obs GROUP BY novel_id)
SELECT id, CASE WHEN derived_state = 'live' AND status_hint = 'completed' AND epoch(TIMESTAMP '{a.NOW}') - coalesce(epoch(latest), 0) >= 30 * 86400 THEN 'likely_complete' ELSE derived_state END AS derived_state
FROM novels LEFT JOIN latest ON id = novel_id"""
)
def completion_state(spark, d):
    return lifecycle.reevaluate(a.novels(spark, d), a.observations(spark, d), a.NOW).select("id", "derived_state")


@query(
    f"""WITH {a.GAPS}, {a.NOVELS}, open AS (SELECT novel_id, count(*) AS n FROM gaps WHERE number % 2 = 0 GROUP BY novel_id), t AS (SELECT DISTINCT novel_id FROM held)
SELECT id, CASE WHEN derived_state = 'backfilling' AND t.novel_id IS NOT NULL AND open.n IS NULL THEN 'live' ELSE derived_state END AS derived_state, coalesce(open.n, 0) AS open_numbers
FROM novels LEFT JOIN t ON id = t.novel_id LEFT JOIN open ON id = open.novel_id"""
)
def backfill_transition(spark, d):
    """Target is 1 to the largest number; odd missing numbers are recorded gaps."""
    have = a.held_numbers(spark, d)
    target = gaps.expected_numbers(have)
    lacking = gaps.missing(target, have)
    still = gaps.missing(lacking, lacking.filter("number % 2 = 1")).groupBy("novel_id").agg(F.count("*").alias("open_numbers"))
    met = a.novels(spark, d).join(target.select("novel_id").distinct(), F.col("id") == F.col("novel_id"), "left").withColumnRenamed("novel_id", "t").join(still, F.col("id") == still["novel_id"], "left")
    done = F.col("t").isNotNull() & F.col("open_numbers").isNull()
    return met.select("id", F.when((F.col("derived_state") == "backfilling") & done, "live").otherwise(F.col("derived_state")).alias("derived_state"), F.coalesce("open_numbers", F.lit(0)).alias("open_numbers"))


@query(
    f"""SELECT user_id AS novel_id, max(ts) AS latest, epoch(TIMESTAMP '{a.EVENTS_NOW}') - epoch(max(ts)) >= 3 * 86400 AS quiet FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id"""
)
def quiet_novels(spark, d):
    seen = a.table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("novel_id"), F.col("ts").alias("fetched_at"))
    return lifecycle.last_fetch(seen).withColumn("quiet", lifecycle.quiet(F.col("latest"), F.lit(a.EVENTS_NOW).cast("timestamp"), 3))


@query(
    f"""WITH s AS (SELECT user_id AS id, max(ts) AS last_synced FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT id, last_synced FROM s WHERE NOT (id % 2 = 0 AND epoch(TIMESTAMP '{a.EVENTS_NOW}') - epoch(last_synced) < 4 * 86400)"""
)
def recheck_due(spark, d):
    seen = a.table(spark, d, "events").filter("event_type <> 'error'").select(F.col("user_id").alias("novel_id"), F.col("ts").alias("last_synced_at"))
    novels = seen.select(F.col("novel_id").alias("id")).distinct().withColumn("derived_state", F.when(F.col("id") % 2 == 0, "likely_complete").otherwise("live"))
    return lifecycle.due(novels, seen, a.EVENTS_NOW, 4).select("id", "last_synced")


_RETAIN = f"""WITH {a.NOVELS}, {a.OBS}, c AS (SELECT novel_id, number, source_id, exported, CASE WHEN exported THEN fetched_at END AS exported_at FROM obs), p AS (
    SELECT c.*, exported AND exported_at IS NOT NULL AND epoch(exported_at) <= epoch(TIMESTAMP '{a.NOW}') - 365 * 86400 AND derived_state = 'likely_complete' AS gone FROM c LEFT JOIN novels ON id = novel_id
) SELECT novel_id, number, source_id FROM p WHERE """


def _exported(spark, d):
    return a.observations(spark, d).select("novel_id", "number", "source_id", "exported", F.when(F.col("exported"), F.col("fetched_at")).alias("exported_at"))


@query(_RETAIN + "coalesce(gone, FALSE)")
def retention_purge(spark, d):
    return lifecycle.purged(_exported(spark, d), a.novels(spark, d), a.NOW, 365).select("novel_id", "number", "source_id")


@query(_RETAIN + "NOT coalesce(gone, FALSE)")
def retention_keep(spark, d):
    return lifecycle.retain(_exported(spark, d), a.novels(spark, d), a.NOW, 365).select("novel_id", "number", "source_id")


@query(
    f"""WITH {a.NOVELS}, {a.OBS}, n AS (SELECT novel_id, count(*) FILTER (WHERE outcome = 'ok' AND fetched_at >= TIMESTAMP '2001-01-01') AS fresh FROM obs GROUP BY novel_id)
SELECT id, coalesce((derived_state = 'backfilling' AND coalesce(fresh, 0) > 0) OR (coalesce(fresh, 0) > 0 AND derived_state IN ('live', 'likely_complete')) OR export_pending, FALSE) AS wanted FROM novels LEFT JOIN n ON id = novel_id"""
)
def post_sync_export(spark, d):
    n = a.observations(spark, d).groupBy("novel_id").agg(F.count_if((F.col("outcome") == "ok") & (F.col("fetched_at") >= F.lit("2001-01-01").cast("timestamp"))).alias("fresh"))
    met = a.novels(spark, d).join(n, F.col("id") == F.col("novel_id"), "left").na.fill(0, ["fresh"])
    new = F.when((F.col("derived_state") == "backfilling") & (F.col("fresh") > 0), "live").otherwise(F.col("derived_state"))
    return met.select("id", lifecycle.export_wanted(F.col("derived_state"), new, F.col("fresh"), F.lit(0), F.col("export_pending")).alias("wanted"))


@query(
    f"""WITH {a.SRC}, c AS (SELECT *, max(source_id) OVER (PARTITION BY novel_id) AS chosen FROM src)
SELECT novel_id, source_id, row_number() OVER (PARTITION BY novel_id ORDER BY CASE WHEN source_id = chosen THEN 0 ELSE 1 END, priority) AS priority FROM c"""
)
def promote_source(spark, d):
    src = a.sources(spark, d)
    last = src.groupBy("novel_id").agg(F.max("source_id").alias("chosen"))
    return maintenance.reorder(src.join(last, "novel_id"), F.col("source_id") == F.col("chosen")).select("novel_id", "source_id", "priority")


@query(f"WITH {a.SRC} SELECT novel_id, coalesce(max(priority), 0) + 1 AS next_priority FROM src GROUP BY novel_id")
def next_priority(spark, d):
    return maintenance.next_priorities(a.sources(spark, d))


@query(
    f"""WITH {a.NOVELS}, {a.SRC}, {a.HELD}, c AS (SELECT novel_id, count(*) AS n, max(number) AS top FROM held GROUP BY novel_id), s AS (SELECT novel_id, count(*) AS n, min_by(source_id, priority) AS p FROM src GROUP BY novel_id)
SELECT id, title, coalesce(c.n, 0) AS n_chapters, top AS last_number, coalesce(s.n, 0) AS n_sources, p AS primary_source FROM novels LEFT JOIN c ON id = c.novel_id LEFT JOIN s ON id = s.novel_id"""
)
def novel_rollup(spark, d):
    src = a.sources(spark, d).withColumnRenamed("source_id", "id")
    return reports.novel_rollup(a.novels(spark, d), src, a.held_numbers(spark, d)).select("id", "title", "n_chapters", "last_number", "n_sources", "primary_source")


@query(
    f"""WITH {a.NOVELS}, {a.SRC}, {a.GAPS}, c AS (SELECT novel_id, count(*) AS n FROM held GROUP BY novel_id), g AS (SELECT novel_id, count(*) AS n, string_agg(number, ', ' ORDER BY number) AS l FROM gaps GROUP BY novel_id),
s AS (SELECT novel_id, string_agg('[' || CASE WHEN priority = 1 THEN 'primary' ELSE 'fallback' END || '] ' || s_name || ' — supplier/' || source_id || '/' || novel_id || ' (not yet synced)', chr(10) ORDER BY priority) AS l FROM src JOIN supplier ON s_suppkey = source_id GROUP BY novel_id)
SELECT id AS novel_id, '#' || id || '  ' || title || ' — Unknown Author  [' || coalesce(c.n, 0) || ' chapters, ' || derived_state || CASE WHEN export_pending THEN ', export pending' ELSE '' END || ']' AS line,
g.n || ' unavailable at source (404): ch. ' || g.l AS gap_line, coalesce(s.l, '') AS source_lines
FROM novels LEFT JOIN c ON id = c.novel_id LEFT JOIN g ON id = g.novel_id LEFT JOIN s ON id = s.novel_id"""
)
def subs_report(spark, d):
    named = a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    src = a.sources(spark, d).join(named, "source_id")
    url = F.concat(F.lit("supplier/"), F.col("source_id").cast("string"), F.lit("/"), F.col("novel_id").cast("string"))
    src = src.select(F.col("source_id").alias("id"), "novel_id", "source_name", url.alias("url"), "priority", F.lit(None).cast("bigint").alias("last_seen_chapter"))
    have = a.held_numbers(spark, d)
    out = reports.subscription_lines(a.novels(spark, d), src, have, gaps.missing(gaps.expected_numbers(have), have))
    return out.withColumn("source_lines", F.array_join("source_lines", "\n"))


@query(
    f"""WITH {a.SRC}, {a.NOVELS} SELECT novel_id, source_id, priority, title AS novel_title, s_name AS source_name FROM src JOIN novels ON id = novel_id JOIN supplier ON s_suppkey = source_id"""
)
def sources_with_titles(spark, d):
    from ..sources.library import sources_with_titles as met

    named = a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    return met(a.sources(spark, d), a.novels(spark, d)).join(named, "source_id").select("novel_id", "source_id", "priority", "novel_title", "source_name")


@query(r"SELECT p_partkey, lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')) AS key FROM part")
def normalized_titles(spark, d):
    return a.table(spark, d, "part").select("p_partkey", text.normalize_title(F.col("p_name")).alias("key"))


@query(
    r"""WITH t AS (SELECT page_id, lower(regexp_replace(regexp_replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&quot;', '"'), '&amp;?', '&', 'g'), '[^\p{L}\p{N}]', '', 'g')) AS key FROM pages)
SELECT key, count(*) AS n, min(page_id) AS first_page FROM t GROUP BY key HAVING count(*) > 1"""
)
def duplicate_titles(spark, d):
    t = html.with_page(a.table(spark, d, "pages").select("page_id", "html"), fields=("title",)).select("page_id", text.normalize_title(F.col("page.title")).alias("key"))
    return t.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '/' || p_brand || '?' WHEN 1 THEN 'con.' || p_name WHEN 2 THEN p_name || ' . ' WHEN 3 THEN '???' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS author FROM part),
c AS (SELECT *, trim(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '[. ]+$', '')) AS n, trim(regexp_replace(regexp_replace(author, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '[. ]+$', '')) AS w FROM t),
r AS (SELECT *, CASE WHEN upper(split_part(n, '.', 1)) = 'CON' THEN '_' || n ELSE n END AS m FROM c),
f AS (SELECT *, CASE WHEN regexp_full_match(m, '_*') THEN 'untitled' ELSE m END AS name FROM r)
SELECT p_partkey, coalesce(w, 'Unknown Author') || '/' || name || '/' || name || ' - Vol ' || lpad(CAST(p_partkey % 7 + 1 AS VARCHAR), 2, '0') || '.epub' AS path FROM f"""
)
def sanitized_paths(spark, d):
    p = a.table(spark, d, "part")
    k = F.col("p_partkey")
    title = F.when(k % 5 == 0, F.concat("p_name", F.lit("/"), "p_brand", F.lit("?"))).when(k % 5 == 1, F.concat(F.lit("con."), "p_name")).when(k % 5 == 2, F.concat("p_name", F.lit(" . "))).when(k % 5 == 3, F.lit("???")).otherwise(F.col("p_name"))
    author = F.when(k % 4 != 0, F.col("p_type"))
    return p.select("p_partkey", urls.book_path(author, title, (k % 7 + 1).cast("int")).alias("path"))


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS base FROM pages"""
)
def url_parts(spark, d):
    return a.table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.base_url(F.col("url")).alias("base"))


@query(
    r"""WITH u AS (SELECT page_id, 'https://x.org/novel/t' || page_id || CASE page_id % 4 WHEN 0 THEN '/chapter-' || page_id || '-a.html' WHEN 1 THEN '/chapter-house/chapter-12' WHEN 2 THEN '/chapter-99999999999' ELSE '/about' END AS url FROM pages),
n AS (SELECT *, TRY_CAST(regexp_extract(split_part(url, 'chapter-', 2), '^[0-9]+') AS BIGINT) AS k FROM u) SELECT page_id, 't' || page_id AS slug, CASE WHEN k <= 4294967295 THEN k END AS number FROM n"""
)
def url_number(spark, d):
    k = F.col("page_id")
    tail = F.when(k % 4 == 0, F.concat(F.lit("/chapter-"), k.cast("string"), F.lit("-a.html"))).when(k % 4 == 1, F.lit("/chapter-house/chapter-12")).when(k % 4 == 2, F.lit("/chapter-99999999999")).otherwise(F.lit("/about"))
    u = a.table(spark, d, "pages").select("page_id", F.concat(F.lit("https://x.org/novel/t"), k.cast("string"), tail).alias("url"))
    return u.select("page_id", urls.slug(F.col("url")).alias("slug"), urls.chapter_number(F.col("url")).alias("number"))


@query(
    f"""WITH {a.TEXTS}, r AS (SELECT novel_id, number, title, trim(regexp_replace(regexp_extract(title, '^(?i:chapter) *[0-9]+ *(.*)$', 1), '^[-:|–—] *', '')) AS rest FROM texts)
SELECT novel_id, number, CASE WHEN rest <> '' THEN rest ELSE title END AS clean FROM r"""
)
def clean_titles(spark, d):
    return a.chapter_texts(spark, d).select("novel_id", "number", text.clean_chapter_title(F.col("title")).alias("clean"))


@query(
    """WITH l AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN ' Ongoing ' WHEN 1 THEN '2' WHEN 2 THEN 'FINISHED' WHEN 3 THEN 'hiatus' WHEN 4 THEN 'Releasing' ELSE o_orderstatus END AS label FROM orders), h AS (
SELECT CASE WHEN lower(trim(label)) IN ('1', 'ongoing', 'on going', 'serializing', 'active', 'releasing') THEN 'ongoing' WHEN lower(trim(label)) IN ('2', 'completed', 'complete', 'finished') THEN 'completed' ELSE 'unknown' END AS hint FROM l)
SELECT hint, count(*) AS n FROM h GROUP BY hint"""
)
def status_counts(spark, d):
    k = F.col("o_orderkey") % 6
    label = F.when(k == 0, " Ongoing ").when(k == 1, "2").when(k == 2, "FINISHED").when(k == 3, "hiatus").when(k == 4, "Releasing").otherwise(F.col("o_orderstatus"))
    return a.table(spark, d, "orders").groupBy(status_hint(label).alias("hint")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&quot;', chr(34)), '&amp;?', '&', 'g') AS title FROM pages")
def page_titles(spark, d):
    return html.with_page(a.table(spark, d, "pages").select("page_id", "html"), fields=("title",)).select("page_id", text.trim_all(F.col("page.title")).alias("title"))


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) <= 2000 AND (contains(lower(text), 'and the') OR contains(lower(text), 'de la'))")
def stub_scan(spark, d):
    docs = a.table(spark, d, "documents")
    return docs.filter(text.is_gate_stub(F.col("text"), ("and the", "de la"))).select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"))


@query(
    """WITH t AS (SELECT doc_id AS novel_id, text FROM documents WHERE length(text) < 400), c AS (SELECT doc_id - 1 AS novel_id, 1 AS priority, doc_id AS source_id, text FROM documents UNION ALL SELECT doc_id - 2, 2, doc_id, text FROM documents),
m AS (SELECT t.novel_id, c.priority, c.source_id, CASE WHEN c.source_id IS NULL THEN 'no source lists it' WHEN length(c.text) <= length(t.text) THEN 'not longer than what is held' END AS reason FROM t LEFT JOIN c ON c.novel_id = t.novel_id)
SELECT novel_id, CASE WHEN bool_or(reason IS NULL) THEN 'repaired' ELSE 'skipped' END AS outcome, min_by(source_id, priority) FILTER (WHERE reason IS NULL) AS n_source, CASE WHEN NOT bool_or(reason IS NULL) THEN max_by(reason, coalesce(priority, 0)) END AS reason FROM m GROUP BY novel_id"""
)
def repair_plan(spark, d):
    """Short documents as targets; the next two documents as the copies of two sources."""
    docs = a.table(spark, d, "documents").select("doc_id", "text")
    targets = docs.filter(F.char_length("text") < 400).select(F.col("doc_id").alias("novel_id"), F.lit(1).cast("bigint").alias("number"), F.col("text").alias("body"))
    of = lambda k: docs.select((F.col("doc_id") - k).alias("novel_id"), F.lit(1).cast("bigint").alias("number"), F.lit(k).alias("priority"), F.col("doc_id").alias("source_id"), F.lit("ok").alias("outcome"), F.lit("t").alias("title"), F.array("text").alias("paragraphs"))
    return maintenance.repair_plan(targets, of(1).unionByName(of(2))).select("novel_id", "outcome", "n_source", "reason")


@query(
    r"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: substring(lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), 1, 160)) AS ps FROM documents)
SELECT b.doc_id - 1 AS novel_id, round(len(list_filter(b.ps, lambda x: list_contains(s.ps, x))) / len(b.ps), 6) AS overlap FROM p b JOIN p s ON s.doc_id = b.doc_id - 1"""
)
def paragraph_overlap(spark, d):
    """Each document against the next one."""
    docs = a.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("paragraphs"))
    one = F.lit(1).cast("bigint").alias("number")
    stored = docs.select(F.col("doc_id").alias("novel_id"), one, "paragraphs")
    remote = docs.select((F.col("doc_id") - 1).alias("novel_id"), one, "paragraphs")
    return reports.paragraph_overlap(stored, remote).select("novel_id", F.round("overlap", 6).alias("overlap"))


@query(
    """SELECT conv_id AS novel_id, turn + 1 AS number, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS joined FROM conversations"""
)
def body_paragraphs(spark, d):
    return a.chapter_texts(spark, d).select("novel_id", "number", F.array_join(text.body_paragraphs(F.col("body")), "\n").alias("joined"))


@query(f"WITH {a.TEXTS} SELECT novel_id, number, CAST((row_number() OVER (PARTITION BY novel_id ORDER BY number) - 1) // 2 + 1 AS INTEGER) AS volume FROM texts")
def volumes(spark, d):
    return export.volumes(a.chapter_texts(spark, d), 2).select("novel_id", "number", "volume")


@query(
    f"""WITH {a.GAPS}, v AS (SELECT novel_id, number, CAST((row_number() OVER (PARTITION BY novel_id ORDER BY number) - 1) // 2 + 1 AS INTEGER) AS volume FROM held), e AS (SELECT novel_id, volume, min(number) AS f, max(number) AS l FROM v GROUP BY ALL)
SELECT gaps.novel_id, volume, number FROM gaps JOIN e ON gaps.novel_id = e.novel_id AND number BETWEEN f AND l"""
)
def volume_gaps(spark, d):
    have = a.held_numbers(spark, d)
    return export.volume_gaps(export.volumes(have, 2), gaps.missing(gaps.expected_numbers(have), have))


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""WITH {a.TEXTS} SELECT novel_id, number, 'chapter_' || lpad(CAST(number AS VARCHAR), 5, '0') || '.xhtml' AS file,
'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || {_esc("'Chapter ' || number || ': ' || title")} || '</title></head><body><h1>' || {_esc("'Chapter ' || number || ': ' || title")} || '</h1>' || chr(10) ||
array_to_string(list_transform(string_split(body, chr(10) || chr(10)), lambda x: '<p>' || {_esc("x")} || '</p>' || chr(10)), '') || '</body></html>' AS xhtml FROM texts"""
)
def chapter_xhtml(spark, d):
    return a.chapter_texts(spark, d).select("novel_id", "number", export.chapter_file(F.col("number")).alias("file"), export.chapter_xhtml(F.col("number"), F.col("title"), text.split_body(F.col("body"))).alias("xhtml"))


@query(
    """SELECT 'orders without lines' AS rule, count(*) AS n FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'lines without order', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey"""
)
def fk_orphans(spark, d):
    o, l = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))  # noqa: E741
    one = lambda rule, x, y: x.join(y, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return one("orders without lines", o, l).unionByName(one("lines without order", l, o))


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k FROM events")
def event_props(spark, d):
    from ..functions.json_docs import field

    return a.table(spark, d, "events").select("event_id", field(F.get_json_object("props", "$.k")).alias("k"))


@query(
    r"""WITH s AS (SELECT p_partkey AS source_id, p_name AS title, 'https://old.example/novel/s' || (p_partkey % 400) AS url, 's' || (p_partkey % 400) AS slug FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT 's' || (p_partkey % 400) AS slug, min_by(p_name, p_partkey) AS title FROM part WHERE p_partkey % 6 <> 0 GROUP BY ALL),
t AS (SELECT lower(regexp_replace(title, '[^\p{L}\p{N}]', '', 'g')) AS key, min(slug) AS t_slug FROM c GROUP BY ALL),
m AS (SELECT s.*, c.title AS c_title, t_slug, coalesce(lower(regexp_replace(c.title, '[^\p{L}\p{N}]', '', 'g')) = lower(regexp_replace(s.title, '[^\p{L}\p{N}]', '', 'g')), FALSE) AS direct FROM s LEFT JOIN c ON c.slug = s.slug LEFT JOIN t ON t.key = lower(regexp_replace(s.title, '[^\p{L}\p{N}]', '', 'g')))
SELECT source_id, CASE WHEN direct OR t_slug IS NOT NULL THEN 'moved' ELSE 'not_found' END AS outcome, CASE WHEN direct THEN 'https://new.example/novel/' || slug ELSE 'https://new.example/novel/' || t_slug END AS new_url, NOT direct AND t_slug IS NOT NULL AS via_title_search FROM m"""
)
def migration_outcome(spark, d):
    """Parts as novels on a host that went away, and as the catalogue of another."""
    p = a.table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("s"), (F.col("p_partkey") % 400).cast("string")).alias("slug"))
    mine = p.filter("p_partkey % 2 = 0")
    novels = mine.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    src = mine.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("novel_id"), F.concat(F.lit("https://old.example/novel/"), "slug").alias("url"), F.lit(1).alias("priority"))
    cat = p.filter("p_partkey % 6 <> 0").groupBy("slug").agg(F.min_by("p_name", "p_partkey").alias("title")).withColumn("reachable", F.lit(True))
    plan = maintenance.migration_plan(src, novels, cat, "old.example", lambda s: F.concat(F.lit("https://new.example/novel/"), s))
    return plan.select("source_id", "outcome", "new_url", "via_title_search")


@query(
    f"""WITH {a.CAND}, {a.NOVELS}, have AS (SELECT DISTINCT novel_id, number FROM obs WHERE exported AND outcome = 'ok'), need AS (SELECT DISTINCT novel_id, number FROM cand ANTI JOIN have USING (novel_id, number)),
walk AS (SELECT novel_id, number, min(priority) FILTER (WHERE outcome = 'ok') AS ok_rank, bool_or(priority = 1 AND outcome = 'not_found') AS p404 FROM cand SEMI JOIN need USING (novel_id, number) GROUP BY ALL),
opened AS (SELECT novel_id, count(*) AS n FROM walk WHERE ok_rank IS NULL AND NOT coalesce(p404, FALSE) GROUP BY ALL), n AS (SELECT novel_id, count(*) AS newly_fetched, count(*) FILTER (WHERE ok_rank <> 1) AS from_fallback FROM walk WHERE ok_rank IS NOT NULL GROUP BY ALL), t AS (SELECT novel_id, count(DISTINCT number) AS target FROM cand GROUP BY ALL)
SELECT id AS novel_id, derived_state AS prev_state, CASE WHEN derived_state = 'backfilling' THEN CASE WHEN coalesce(target, 0) > 0 AND opened.n IS NULL THEN 'live' ELSE 'backfilling' END WHEN coalesce(newly_fetched, 0) > 0 THEN 'live' ELSE derived_state END AS new_state,
coalesce(target, 0) AS target, coalesce(newly_fetched, 0) AS newly_fetched, coalesce(from_fallback, 0) AS from_fallback, coalesce(opened.n, 0) AS failed
FROM novels LEFT JOIN t ON id = t.novel_id LEFT JOIN n ON id = n.novel_id LEFT JOIN opened ON id = opened.novel_id"""
)
def sync_pass(spark, d):
    """A whole pass: every order's lines seen in full, of which those exported are held already."""
    seen = a.observations(spark, d)
    src = a.sources(spark, d).select(F.concat("source_id", F.lit(":"), "novel_id").alias("key"), "source_id", "novel_id", "priority")
    # a supplier serves many orders; as a source of one novel it is known by both
    ident = lambda s, n: F.xxhash64(s, n)
    sources = src.select(ident("source_id", "novel_id").alias("id"), "novel_id", F.lit("s").alias("source_name"), F.col("key").alias("url"), "priority", F.lit(None).cast("bigint").alias("last_seen_chapter"), F.lit(None).cast("timestamp").alias("last_synced_at"))
    modes = F.explode(F.array(F.lit("full"), F.lit("latest"))).alias("mode")
    discovered = seen.select("novel_id", ident("source_id", "novel_id").alias("source_id"), modes, F.col("number").alias("pos"), "number", F.lit("t").alias("title"), F.lit("u").alias("url"))
    fetched = seen.select("novel_id", ident("source_id", "novel_id").alias("source_id"), "number", "outcome", F.lit("t").alias("title"), F.array(F.lit("x")).alias("paragraphs"), F.lit(None).cast("string").alias("message"))
    held = seen.filter("exported AND outcome = 'ok'").groupBy("novel_id", "number").agg(F.min(ident("source_id", "novel_id")).alias("source_id"), F.max("fetched_at").alias("fetched_at"))
    chapters = held.select("novel_id", "number", F.lit("t").alias("title"), F.lit("x").alias("body"), "source_id", "fetched_at", F.lit(True).alias("exported"), F.col("fetched_at").alias("exported_at"))
    none = chapters.select("novel_id", "number", F.col("fetched_at").alias("detected_at")).filter(F.lit(False))
    done = reconcile.sync_pass(a.novels(spark, d), sources, chapters, none, discovered, fetched, a.NOW)
    return done.report.select("novel_id", "prev_state", "new_state", "target", "newly_fetched", "from_fallback", "failed")
