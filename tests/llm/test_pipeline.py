"""The stages of the pipeline on a planted corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(25)
    docs, labels = [], []
    for i in range(400):
        t, toxic = text(int(rng.integers(20, 60))), int(rng.random() < 0.2)
        if toxic:
            t += " zzscum zzidiot"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, toxic))
    docs += [(1000, docs[0][1], "en", "s0", 1), (1001, text(30) + " " + passage + " " + text(5), "en", "s1", 1), (1002, None, None, None, None), (1003, "", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "?")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i for i, _, t in labels if t}


def test_stages(spark, corpus):
    folder, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, text = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, folder), name)
        assert docs.columns == columns
        text[name] = {r.doc_id: r.text for r in docs.collect()}
        ids[name] = set(text[name])
    clean = set(range(400)) - toxic
    assert len(ids["toxicity"] & toxic) <= 2 and len(clean - ids["toxicity"]) <= 2
    assert ids["line_dedup"] == ids["toxicity"]
    if 0 in ids["toxicity"] and 1000 in ids["toxicity"]:
        assert text["line_dedup"][1000] == ""
    assert clean & ids["toxicity"] <= ids["near_dedup"]
    assert 1001 in ids["near_dedup"] and 1001 not in ids["decontamination"]
    assert clean & ids["toxicity"] <= ids["decontamination"]
    mixed = corpus_pipeline.mixing(spark, docs, folder).collect()
    assert len(mixed) == len(ids["decontamination"]) and all(r.taken <= 3 * r["size"] for r in mixed)


def test_run(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 200
    assert set(corpus_pipeline.queries()) == {"pipeline"} and corpus_pipeline.oracle_sql() == {}


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_near_dedup_finds_similar_texts(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{k}" for k in rng.integers(0, 5000, 200)] for _ in range(20)]
    near = [[*w[:90], "x", "y", *w[92:]] for w in base]  # 190 of 202 shingles: 0.94
    far = [[*w[:60], *(f"z{i}{k}" for k in range(80)), *w[140:]] for i, w in enumerate(base)]  # under 0.5
    docs = [(k * 100 + i, " ".join(w), "en", "s", 1) for k, group in enumerate((base, near, far)) for i, w in enumerate(group)]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, COLUMNS), "").collect()}
    assert kept == {*range(20), *range(200, 220)}


def test_verdicts_are_of_rows(spark, corpus):
    """Null and repeated doc_ids: a verdict on one row says nothing of others."""
    folder, _ = corpus
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text
    rows = [(None, "clean words of its own one"), (None, "other clean text without an id"), (None, "before " + passage), (7, "seven is clean here"), (7, passage + " after"), (8, "a copy of a text kept under eight"), (None, "a copy of a text kept under eight"), (None, "a copy of a text kept under eight")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, folder).collect()), key=str)
    assert left == sorted((r for r in rows if passage not in r[1]), key=str)
    near = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()]
    assert sorted(near, key=str) == sorted([*rows[:2], *rows[3:6]], key=str)  # the third is near the fifth


def test_toxicity_rejects_by_language(spark, corpus, monkeypatch):
    folder, _ = corpus
    scored = spark.createDataFrame([(1, "a", "en", "s", 1, 0, True), (2, "b", "de", "s", 1, 1, False)], COLUMNS + ", predicted int, toxic_by_lang boolean")
    monkeypatch.setattr(corpus_pipeline, "learn", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "score_texts", lambda *_: scored)
    docs = scored.select("doc_id", "text", "lang", "source", "n_chars")
    assert [r.doc_id for r in corpus_pipeline.toxicity(spark, docs, folder).collect()] == [2]


def test_stages_pass_clashing_columns_and_empty_tables(spark, corpus):
    folder, _ = corpus
    names = ["score", "predicted", "toxic_by_lang", "held_out", "n_lines", "n_removed", "gone", "component", "__gone", "th", "row", "hit_id", "node", "id", "lead", "__text", "at", "last", "keys", "h1"]
    docs = spark.createDataFrame([(5001, "one line\nother line", "en", "s", 3), (None, None, None, None, None), (5002, "", "en", None, 0)], COLUMNS)
    docs = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for given, count in ((docs, 3), (docs.limit(0), 0)):
        now = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.keep(stage(spark, now, folder), name)
            assert now.columns == docs.columns
            assert all(r[n] == f"own {n}" for r in now.collect() for n in names)
        assert (now.count() == 0) == (count == 0)
        assert corpus_pipeline.mixing(spark, now, folder).count() == now.count()


def test_near_dedup_links_fingerprints_too(spark):
    """Repeats weigh in a fingerprint, not in a set: two texts with equal fingerprints and few common shingles are near."""
    chant = " ".join(["one two three four five six seven"] * 50)
    docs = [(1, chant + " but here it ends with words of its own", "en", "s", 1), (2, chant + " while this goes on to something else", "en", "s", 1), (3, "a text that has nothing to do with them", "en", "s", 1)]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, COLUMNS), "").collect()} == {1, 3}
