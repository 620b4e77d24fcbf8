"""Libraries of an older schema brought to the current one, in one verified step.

Each step makes new tables out of the old; a table that a step does not name
keeps its files. Before anything counts, every table that was made anew must
hold the keys of the old one, no more and no fewer rows, and nothing may hang
on a novel that is gone; else the library stays as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger
from .schemas import SCHEMA, TABLES

Tables = dict[str, DataFrame]
MARKS = {"novels": "novels.next_id", "sources": "sources.next_id"}


def _later_columns(old: Tables) -> Tables:
    """What came after the first tables: flags that are false where they were not known; the rest is null."""
    return {
        "novels": old["novels"].withColumn("export_pending", F.coalesce("export_pending", F.lit(False))),
        "chapters": old["chapters"].withColumn("exported", F.coalesce("exported", F.lit(False))),
    }


def _marks(old: Tables) -> Tables:
    """The next id of novels and sources, as far as the rows that are left can tell."""
    made = None
    for table, key in MARKS.items():
        top = old[table].agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("string").alias("value")).select(F.lit(key).alias("key"), "value")
        made = top if made is None else made.unionByName(top)
    return {"meta": old["meta"].unionByName(made.join(old["meta"].select("key"), "key", "left_anti"))}


STEPS: dict[int, Callable[[Tables], Tables]] = {0: _later_columns, 1: _marks}


def snapshot(spark: SparkSession, folder: str) -> Tables | None:
    """The tables of a library of schema 0: folders of a snapshot that a file CURRENT names."""
    if "CURRENT" not in ledger.names_in(spark, folder):
        return None
    name = spark.read.text(f"{folder}/CURRENT").first()[0]
    return {t: spark.read.schema(spark.createDataFrame([], ddl).schema).parquet(f"{folder}/{name}/{t}") for t, ddl in TABLES.items()}


def _differ(table: str, old: DataFrame, new: DataFrame) -> list[str]:
    key = ledger.UNIQUE[table][0]
    one = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    counts = one(old, "old").unionByName(one(new, "new")).unionByName(one(old.select(*key).join(new.select(*key), key, "left_anti"), "lost"))
    n = {r["rule"]: r["n"] for r in counts.collect()}
    # marks are added to meta
    wrong = n["lost"] or (n["old"] != n["new"] and table != "meta")
    return [f"{table}: {n['new']} rows of {n['old']}, {n['lost']} keys lost"] if wrong else []


def rebuild(spark: SparkSession, folder: str, steps: dict[int, Callable[[Tables], Tables]] | None = None, target: int = SCHEMA) -> int | None:
    """Brings the library to ``target``. Returns the new version's number; None if it is there already, or no library."""
    steps = STEPS if steps is None else steps
    found = ledger.version_at(spark, folder)
    if found is None:
        old, schema = snapshot(spark, folder), 0
    else:
        old, schema = ledger.tables_at(spark, folder, found), found.schema
    if old is None or schema >= target:
        return None
    now = ledger.Pass(spark, folder, found or ledger.Version(0, 0), target)
    tables, made = dict(old), set() if found else set(TABLES)
    for s in range(schema, target):
        new = steps[s](tables)
        tables |= new
        made |= set(new)
    for t in made:
        now.replace(t, tables[t])
    # what was written is held against what was there, not the plan that made it
    if bad := [x for t in sorted(made) for x in _differ(t, old[t], now.table(t))]:
        raise ledger.LedgerError(f"the rebuild is given up: {'; '.join(bad)}")
    return now.commit(f"schema {schema} to {target}")
