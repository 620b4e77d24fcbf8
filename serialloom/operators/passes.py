"""The library's changes as parts of a pass over it on disk: each writes the files that it touches, and says what it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import LedgerError, Pass
from . import lifecycle
from .gaps import KEY
from .maintenance import HIGH_WATER


def _ids(p: Pass, *ids: int, name: str = "id") -> DataFrame:
    return p.spark.createDataFrame([(i,) for i in ids], f"{name} bigint")


def _mark(p: Pass, key: str, value: int) -> None:
    row = p.spark.createDataFrame([(key, str(value))], "key string, value string")
    p.replace("meta", p.table("meta").filter(F.col("key") != key).unionByName(row))


def insert_chapters(p: Pass, new: DataFrame) -> int:
    """Chapters that are not there yet; of equal keys in ``new`` one is taken. Only the files around them are read, none is written anew."""
    return p.append("chapters", new.join(p.near("chapters", new).select(*KEY), KEY, "left_anti").dropDuplicates(KEY))


def record_gaps(p: Pass, new: DataFrame, now) -> int:
    known = p.near("chapter_gaps", new).select(*KEY)
    return p.append("chapter_gaps", new.select(*KEY).distinct().join(known, KEY, "left_anti").withColumn("detected_at", F.lit(now).cast("timestamp")))


def clear_gaps(p: Pass, filled: DataFrame) -> int:
    return p.delete("chapter_gaps", filled.select(*KEY), KEY)


def replace_content(p: Pass, fresh: DataFrame) -> int:
    """fresh: n_title, n_body, n_source by key. They are to be exported again; their fetch time stays."""
    never = F.lit(None).cast("timestamp")
    return p.update("chapters", fresh, KEY, {"title": F.coalesce("n_title", "title"), "body": F.col("n_body"), "source_id": F.col("n_source"), "exported": F.lit(False), "exported_at": never}, F.col("n_body").isNotNull())


def retitle(p: Pass, titles: DataFrame) -> int:
    """titles: n_title by key; counts those that differ, which are to be exported again."""
    return p.update("chapters", titles.select(*KEY, "n_title"), KEY, {"title": F.col("n_title"), "exported": F.lit(False), "exported_at": F.lit(None).cast("timestamp")}, F.col("n_title") != F.col("title"))


def mark_exported(p: Pass, novels: DataFrame, now) -> int:
    """All chapters of these novels (novel_id), and the novels are pending no more."""
    which = novels.select("novel_id").distinct()
    p.update("novels", which.withColumnRenamed("novel_id", "id"), ["id"], {"export_pending": F.lit(False)}, F.col("export_pending"))
    return p.update("chapters", which, ["novel_id"], {"exported": F.lit(True), "exported_at": F.lit(now).cast("timestamp")})


def mark_chapters_exported(p: Pass, chapters: DataFrame, now) -> int:
    """These chapters (by key), and their novels are pending no more."""
    p.update("novels", chapters.select(F.col("novel_id").alias("id")).distinct(), ["id"], {"export_pending": F.lit(False)}, F.col("export_pending"))
    return p.update("chapters", chapters.select(*KEY), KEY, {"exported": F.lit(True), "exported_at": F.lit(now).cast("timestamp")})


def set_pending(p: Pass, novels: DataFrame, pending: bool = True) -> int:
    return p.update("novels", novels.select(F.col("novel_id").alias("id")).distinct(), ["id"], {"export_pending": F.lit(pending)}, F.col("export_pending") != pending)


def repoint_source(p: Pass, source_id: int, source_name: str, url: str) -> int:
    """Another URL under the same id; one that another source has is refused with the commit."""
    return p.update("sources", _ids(p, source_id), ["id"], {"source_name": F.lit(source_name), "url": F.lit(url)})


def refresh_metadata(p: Pass, meta: DataFrame, now) -> int:
    """meta: author, cover_url, genre and status_hint by novel_id, taken as they are, nulls too; the title stays."""
    seen = meta.select(F.col("novel_id").alias("id"), *[F.col(c).alias(f"n_{c}") for c in ("author", "cover_url", "genre", "status_hint")])
    return p.update("novels", seen, ["id"], {c: F.col(f"n_{c}") for c in ("author", "cover_url", "genre", "status_hint")} | {"updated_at": F.lit(now).cast("timestamp")})


def unsubscribe(p: Pass, novel_id: int) -> dict[str, int]:
    """The novel and all that hangs on it; how many rows of each table went. Its id is not given again."""
    top = p.table("novels").agg(F.max("id")).first()[0]
    if top is None or p.table("novels").filter(F.col("id") == novel_id).isEmpty():
        raise LedgerError(f"no novel {novel_id}")
    row = p.table("meta").filter(F.col("key") == HIGH_WATER).first()
    _mark(p, HIGH_WATER, max(top + 1, int(row["value"]) if row else 1))
    gone = {"novels": p.delete("novels", _ids(p, novel_id), ["id"])}
    return gone | {t: p.delete(t, _ids(p, novel_id, name="novel_id"), ["novel_id"]) for t in ("sources", "chapters", "chapter_gaps")}


def apply_retention(p: Pass, now, days: int = 30) -> int:
    """Deletes what :func:`.lifecycle.purged` names; how many chapters that were."""
    return p.delete("chapters", lifecycle.purged(p.table("chapters"), p.table("novels"), now, days).select(*KEY), KEY)


def reevaluate(p: Pass, now, grace_days: int = 30) -> int:
    """Live titles that are labelled completed and quiet as likely complete; how many."""
    old = p.table("novels")
    moved = lifecycle.reevaluate(old, p.table("chapters"), now, grace_days).select("id", F.col("derived_state").alias("n_state")).join(old.select("id", "derived_state"), "id").filter("n_state <> derived_state").select("id", "n_state")
    return p.update("novels", moved, ["id"], {"derived_state": F.col("n_state"), "updated_at": F.lit(now).cast("timestamp")})
