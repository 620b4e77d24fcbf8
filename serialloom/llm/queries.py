"""The queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import ODD_TEXT, chat_digest, format_chats

    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(format_chats(turns.unionByName(odd)))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))["documents"]


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score_texts(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", "toxic_by_lang")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import payloads, round_trip

    return payloads(round_trip(table(spark, sf_dir, "pages")))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import coded, compress

    return coded(compress(table(spark, sf_dir, "embeddings")))


def op13_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = {f.__name__: f for f in (op1_multi_index_hashing, op2_substring_dedup, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_line_dedup, op6_chat_formatting, op7_source_mixing, op8_toxicity_cnn, op9_warc_round_trip, op10_hmm_scores, op11_filter_audit, op12_elkan_codes, op13_scaled_sketches)}
    return found


def oracle_sql() -> dict[str, str]:
    from . import audit, chat, codes, decontam, substrings, warc

    return {"op2_substring_dedup": substrings.SQL, "op4_benchmark_decontamination": decontam.SQL, "op6_chat_formatting": chat.SQL, "op9_warc_round_trip": warc.SQL, "op11_filter_audit": audit.SQL, "op12_elkan_codes": codes.SQL}
