"""An extension: the scheduled poll as a stream of observations.

Each micro-batch of fetched outcomes is one incremental pass that appends what
is new, as files of its own; chapters that are there are never overwritten, nor
are their files. A watermark bounds the state of the quiet-grace report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.passes import insert_chapters
from ..sources.ledger import Pass, run_pass
from ..sources.schemas import FETCHED


def read_outcomes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(FETCHED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_copies(batch: DataFrame, sources: DataFrame, now) -> DataFrame:
    """The chapter of the first source by priority that has it, for each key of a batch of outcomes."""
    ranked = batch.filter("outcome = 'ok'").join(sources.select(F.col("id").alias("source_id"), "priority"), "source_id")
    first = ranked.groupBy("novel_id", "number").agg(F.min_by(F.struct("source_id", "title", "paragraphs"), "priority").alias("w"))
    return first.select("novel_id", "number", F.coalesce("w.title", F.lit("")).alias("title"), F.array_join("w.paragraphs", "\n\n").alias("body"), F.col("w.source_id").alias("source_id"), F.lit(now).cast("timestamp").alias("fetched_at"), F.lit(False).alias("exported"), F.lit(None).cast("timestamp").alias("exported_at"))


def poll(outcomes: DataFrame, library_folder: str, checkpoint: str, now):
    """Starts the stream over what is there now (AvailableNow). A batch that comes again after a crash finds its chapters there and adds none."""

    def apply(batch: DataFrame, epoch: int) -> None:
        def work(p: Pass) -> int:
            return insert_chapters(p, first_copies(batch, p.table("sources"), now))

        run_pass(batch.sparkSession, library_folder, work, f"poll {epoch}")

    return outcomes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per novel and window; windows close once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy("novel_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("latest")).select("novel_id", F.col("w.start").alias("window_start"), "n", "latest")
