"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again for the next one. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialloom.llm.components import connected_components
from serialloom.llm.decontam import contaminated
from serialloom.llm.lines import dedup_lines
from serialloom.llm.minhash import near_texts
from serialloom.llm.mixing import mix_sources
from serialloom.llm.simhash import near_duplicates
from serialloom.llm.toxicity import learn, score_texts
from serialloom.session import keep


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names (in any case) renamed, and how to name them back."""
    back = {f"__own_{i}_{c}": c for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's threshold go; it learns from labelled rows among ``docs``.

    A null or empty text is scored like any other; rows that repeat, or have no id, are judged by their own text; columns
    named as the results are stay as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own, back = _aside(docs, "held_out", "score", "predicted", "toxic_by_lang")
    return score_texts(own, learn(docs, labels)).filter(~F.col("toxic_by_lang")).select(*own.columns).withColumnsRenamed(back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of equal or similar lines stays, in the document that has it first; a document that loses all of its lines is empty.

    A null text stays null; n_chars follows the text where lines went; no row goes.
    """
    own, back = _aside(docs, "n_lines", "n_removed")
    done = dedup_lines(own).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*own.columns).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash fingerprints differ in 3 bits at most, or with a Jaccard similarity of 0.8 over five-word shingles, the row with the smallest doc_id (a null one comes last) stays.

    Null and empty texts are alike, without words. Fingerprints link as in op3; MinHash adds the pairs at 0.8, which no SimHash
    distance that blocks can find covers. A row is known by its doc_id and text; of rows that repeat both, one stays. Columns of
    any name are passed as they are.
    """
    found = keep(near_texts(docs.select("doc_id", "text")), "near")
    # the classes of both are joined: those by MinHash that share one by SimHash
    alike = near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text")).select(F.col("doc_id").alias("th"), "component_id").distinct()
    both = keep(found.select("th", "component").distinct().join(alike, "th").select("component", "component_id").distinct(), "both")
    least = both.groupBy("component_id").agg(F.min("component").alias("least"))
    tied = keep(both.join(least, "component_id").filter("component <> least").select("component", "least"), "tied")
    if not tied.isEmpty():
        joined = connected_components(tied).select("node", F.col("component").alias("of"))
        found = found.join(joined, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("of", "component"))
    at = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("th").alias("lead"))
    stays = found.groupBy("component").agg(F.min(at).alias("at")).select("at.id", "at.lead")
    own, back = _aside(docs, "id", "lead", "__text")
    kept = own.withColumn("__text", F.xxhash64("text")).join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("__text") == F.col("lead")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).select(*own.columns).withColumnsRenamed(back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # the verdict hangs on the text alone, and so does its name; a doc_id may be null or repeat
    text = F.xxhash64("text")
    hit = contaminated(docs.select(text.alias("doc_id"), "text"), bench)
    own, back = _aside(docs, "hit_id")
    return own.join(hit, text == F.col("hit_id"), "left_anti").withColumnsRenamed(back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target and taken."""
    return mix_sources(docs)["documents"].select("doc_id", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier and the block permutation are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
