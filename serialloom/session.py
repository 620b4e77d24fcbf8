"""What the engine needs from a session: where it may keep results, and how it keeps them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="serialloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/serialloom-{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    The lineage ends there, so a lost executor costs no more than the tasks
    that it ran, and what two later branches read is worked out once. The
    shuffle files of the step are dropped as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, "false")
    spark.conf.set(flag, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(flag, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what :func:`keep` wrote for ``df``, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/serialloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
