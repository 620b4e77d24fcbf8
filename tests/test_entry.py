"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_holds_without_llm(tmp_path):
    for name in ("serialloom", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "serialloom" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink()  # the one file outside the folders that needs them goes with them
    code = "import __spark_entry__ as e; assert 'library_gaps' in e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_every_key_of_the_sql_is_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert not e.entry(spark).isEmpty()


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", ["library_gaps", "ranked_pick", "retention_purge", "repair_plan", "migration_outcome", "chapter_xhtml", "subs_report", "chapter_title_forms", "page_title_forms", "visible_positions", "page_profile_fields", "paged_contents", "newest_first_contents", "remote_samples", "chapter_pages", "site_variants", "gap_summary"])
def test_queries_agree_with_their_sql(spark, name):
    import __spark_entry__ as e

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(e.oracle_sql()[name])
    cols = sorted(want.columns)
    df = e.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == cols
    mine = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    assert mine == sorted(map(repr, want.select(*cols).fetchall()))


def test_poll(spark, tmp_path):
    import datetime as dt

    from serialloom.sources import schemas
    from serialloom.sources.library import Library, open_library, save_library
    from serialloom.streaming.poll import poll, read_outcomes

    t = dt.datetime(2001, 1, 1)
    lib = Library.of(spark, novels=[(1, "N", None, None, None, "unknown", "live", False, t, t)], sources=[(1, 1, "a", "u", 1, None, None), (2, 1, "b", "v", 2, None, None)], chapters=[(1, 1, "t", "old", 1, t, False, None)])
    save_library(lib, str(tmp_path / "lib"))
    spark.createDataFrame([(1, 1, 1, "ok", "t", ["new"], None), (1, 2, 2, "ok", "t", ["b"], None), (1, 1, 2, "ok", "t", ["a"], None), (1, 1, 3, "error", None, None, "x")], schemas.FETCHED).write.parquet(str(tmp_path / "in"))
    poll(read_outcomes(spark, str(tmp_path / "in")), str(tmp_path / "lib"), str(tmp_path / "cp"), t).awaitTermination(60)
    got = sorted((r.number, r.body) for r in open_library(spark, str(tmp_path / "lib")).chapters.collect())
    assert got == [(1, "old"), (2, "a")]
