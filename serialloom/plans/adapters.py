"""The supplied tables seen as the engine's: orders are novels, line items are observations of their chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries never ask for the time.
NOW, EVENTS_NOW = "2001-12-01 00:00:00", "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a dealt table that one task gets.
_DEALT = 250_000


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """These columns of the table, dealt by ``key``: what is grouped or joined by it is not shuffled again.

    The number of tasks follows the rows (a count that reads no column), so that a task's memory does not grow with the table.
    """
    rows = table(spark, sf_dir, name)
    return rows.select(*columns).repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // _DEALT)), key)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """novel_id, number, source_id, outcome, fetched_at, exported: one row per (novel, source, number)."""
    l = dealt(spark, sf_dir, "lineitem", "l_orderkey", ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"])  # noqa: E741
    last = F.max_by(F.struct("l_returnflag", "l_linestatus", "l_shipdate"), F.struct("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    one = l.groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(last.alias("o")).select("l_orderkey", "l_suppkey", "l_linenumber", "o.*")
    return one.select(
        F.col("l_orderkey").alias("novel_id"),
        F.col("l_linenumber").cast("bigint").alias("number"),
        F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_returnflag") == "R", "not_found").otherwise("ok").alias("outcome"),
        F.col("l_shipdate").alias("fetched_at"),
        (F.col("l_linestatus") == "F").alias("exported"),
    )


OBS = """obs AS (
    SELECT l_orderkey AS novel_id, CAST(l_linenumber AS BIGINT) AS number, l_suppkey AS source_id,
        CASE WHEN l_returnflag = 'R' THEN 'not_found' ELSE 'ok' END AS outcome, l_shipdate AS fetched_at, l_linestatus = 'F' AS exported
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber ORDER BY l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC) = 1
)"""


def held_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("novel_id"), F.col("l_linenumber").cast("bigint").alias("number")).distinct()


HELD = "held AS (SELECT DISTINCT l_orderkey AS novel_id, CAST(l_linenumber AS BIGINT) AS number FROM lineitem)"
GAPS = (
    HELD
    + """, gaps AS (
    SELECT novel_id, number FROM (SELECT novel_id, unnest(range(1, max(number) + 1)) AS number FROM held GROUP BY novel_id)
    ANTI JOIN held USING (novel_id, number)
)"""
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (the supplier's), novel_id and priority."""
    l = dealt(spark, sf_dir, "lineitem", "l_orderkey", ["l_orderkey", "l_suppkey"])  # noqa: E741
    pairs = l.select(F.col("l_orderkey").alias("novel_id"), F.col("l_suppkey").alias("source_id")).distinct()
    return pairs.withColumn("priority", F.row_number().over(Window.partitionBy("novel_id").orderBy("source_id")).cast("bigint"))


SRC = """src AS (
    SELECT novel_id, source_id, row_number() OVER (PARTITION BY novel_id ORDER BY source_id) AS priority
    FROM (SELECT DISTINCT l_orderkey AS novel_id, l_suppkey AS source_id FROM lineitem)
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).join(sources(spark, sf_dir), ["novel_id", "source_id"])


CAND = OBS + ", " + SRC + ", cand AS (SELECT obs.*, priority FROM obs JOIN src USING (novel_id, source_id))"
PICK = CAND + ", pick AS (SELECT * FROM cand WHERE outcome = 'ok' QUALIFY row_number() OVER (PARTITION BY novel_id, number ORDER BY priority) = 1)"


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, status_hint, derived_state, export_pending, created_at."""
    o = table(spark, sf_dir, "orders")
    hint = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "ongoing").otherwise("unknown")
    state = F.when(F.col("o_orderkey") % 3 == 0, "backfilling").when(F.col("o_orderkey") % 3 == 1, "live").otherwise("likely_complete")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Novel "), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), hint.alias("status_hint"), state.alias("derived_state"), (F.col("o_orderkey") % 10 == 0).alias("export_pending"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


NOVELS = """novels AS (
    SELECT o_orderkey AS id, 'Novel ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' ELSE 'unknown' END AS status_hint,
        CASE o_orderkey % 3 WHEN 0 THEN 'backfilling' WHEN 1 THEN 'live' ELSE 'likely_complete' END AS derived_state, o_orderkey % 10 = 0 AS export_pending, o_orderdate AS created_at FROM orders
)"""


def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chapters: novel_id, number, title, body, source_name."""
    c = table(spark, sf_dir, "conversations")
    title = F.concat(F.lit("Chapter "), (F.col("turn") + 1).cast("string"), F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" - "), F.col("role"))).otherwise(F.concat(F.lit(": "), F.col("role"), F.lit(" & <co>"))))
    return c.select(F.col("conv_id").alias("novel_id"), (F.col("turn") + 1).alias("number"), title.alias("title"), F.col("text").alias("body"), F.col("role").alias("source_name"))


TEXTS = """texts AS (
    SELECT conv_id AS novel_id, turn + 1 AS number, 'Chapter ' || (turn + 1) || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' - ' || role ELSE ': ' || role || ' & <co>' END AS title, text AS body, role AS source_name FROM conversations
)"""
