"""Books as a sink: all of them or none, and marks only for what is in them."""

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from serialloom.operators import export, passes
from serialloom.sources import ledger
from serialloom.sources.library import Library, open_library, save_library

T0, NOW = dt.datetime(2001, 1, 1), dt.datetime(2001, 12, 1)


@pytest.fixture
def lib(spark):
    return Library.of(
        spark,
        novels=[(1, "First", "Ann", None, "Sea & Fog", "ongoing", "live", True, T0, T0), (5, "Second", None, None, None, "completed", "live", False, T0, T0), (9, "Empty", None, None, None, "unknown", "live", False, T0, T0)],
        sources=[(1, 1, "a", "https://a.org/1", 1, None, None), (2, 5, "b", "u2", 1, 3, T0)],
        chapters=[(1, n, f"t{n} <&>", f"p{n}\n\nq & r", 1, T0, False, None) for n in (1, 2, 4, 5)] + [(5, 1, "t", "x", 2, T0, False, None)],
        chapter_gaps=[(1, 3, T0), (1, 9, T0)],
    )


def books(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".epub"))


def exported(spark, library):
    return sorted((r.novel_id, r.number) for r in open_library(spark, library).chapters.filter("exported").collect())


def test_export_writes_books_and_marks_their_chapters(spark, lib, tmp_path):
    library, out = str(tmp_path / "lib"), str(tmp_path / "out")
    save_library(lib, library)
    covers = spark.createDataFrame([(1, b"\x89PNG", "image/PNG; q=1"), (5, b"<html>", "text/html")], "novel_id bigint, cover binary, cover_type string")
    some = spark.createDataFrame([(1,), (9,)], "novel_id bigint")
    done = export.export_library(spark, library, out, NOW, some, volume_size=2, covers=covers)
    assert sorted((r.path, r.novel_id, r.chapters) for r in done.collect()) == [("Ann/First/First - Vol 01.epub", 1, 2), ("Ann/First/First - Vol 02.epub", 1, 2)]
    assert books(out) == ["Ann/First/First - Vol 01.epub", "Ann/First/First - Vol 02.epub"] and all(r.bytes == os.path.getsize(f"{out}/{r.path}") for r in done.collect())
    assert exported(spark, library) == [(1, n) for n in (1, 2, 4, 5)]
    assert not open_library(spark, library).novels.filter("export_pending").count()
    with zipfile.ZipFile(f"{out}/Ann/First/First - Vol 01.epub") as z:
        assert z.testzip() is None and z.namelist()[0] == "mimetype" and z.read("OEBPS/cover.png") == b"\x89PNG"
        opf = z.read("OEBPS/content.opf").decode()
        assert "<dc:subject>Sea &amp; Fog</dc:subject>" in opf and "<dc:creator>Ann</dc:creator>" in opf and 'media-type="image/png"' in opf
        assert "Chapter 2: t2 &lt;&amp;&gt;" in z.read("OEBPS/chapter_00002.xhtml").decode() and "OEBPS/missing.xhtml" not in z.namelist()
    assert not [x for x in os.listdir(out) if x.startswith(".books")]


def test_one_book_for_all_chapters(spark, lib, tmp_path):
    library, out = str(tmp_path / "lib"), str(tmp_path / "out")
    save_library(lib, library)
    assert sorted((r.path, r.chapters) for r in export.export_library(spark, library, out, NOW).collect()) == [("Ann/First/First.epub", 4), ("Unknown Author/Second/Second.epub", 1)]
    with zipfile.ZipFile(f"{out}/Ann/First/First.epub") as z:
        assert "<p>By number: 3, 9</p>" in z.read("OEBPS/missing.xhtml").decode() and "a.org" in z.read("OEBPS/missing.xhtml").decode()
    with zipfile.ZipFile(f"{out}/Unknown Author/Second/Second.epub") as z:
        opf = z.read("OEBPS/content.opf").decode()
        assert "dc:creator" not in opf and "dc:subject" not in opf


@pytest.mark.parametrize("pending", [False, True])
def test_a_task_that_fails_leaves_no_book_and_no_mark(spark, lib, tmp_path, monkeypatch, pending):
    library, out = str(tmp_path / "lib"), str(tmp_path / "out")
    save_library(lib, library)
    whole = export.book_documents
    # the last book of the job cannot be written, when others are
    monkeypatch.setattr(export, "book_documents", lambda *a: whole(*a).withColumn("xhtml", F.when(F.col("novel_id") != 5, F.col("xhtml"))))
    with pytest.raises(Exception, match="(?i)python|NoneType|write"):
        export.export_library(spark, library, out, NOW, pending=pending)
    assert books(out) == [] and not [x for x in os.listdir(out) if x.startswith((".books", "_exports"))]
    assert exported(spark, library) == []
    assert sorted(r.id for r in open_library(spark, library).novels.filter("export_pending").collect()) == ([1, 5] if pending else [1])


def test_chapters_that_come_meanwhile_are_not_marked(spark, lib, tmp_path, monkeypatch):
    library, out = str(tmp_path / "lib"), str(tmp_path / "out")
    save_library(lib, library)
    late = lib.chapters.limit(1).withColumn("novel_id", F.lit(5).cast("bigint")).withColumn("number", F.lit(2).cast("bigint"))
    write = export.write_books

    def slow(*args):
        ledger.run_pass(spark, library, lambda p: passes.insert_chapters(p, late))
        return write(*args)

    monkeypatch.setattr(export, "write_books", slow)
    export.export_library(spark, library, out, NOW)
    assert exported(spark, library) == [(1, 1), (1, 2), (1, 4), (1, 5), (5, 1)]
    assert open_library(spark, library).chapters.count() == 6
