"""The filter audit, vector codes and document fingerprints against plain versions."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from serialloom.llm import audit, codes, sketches

# --- filter audit


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > least[t]}
        fails.append((source or "", {f for f, x in own.items() if x}, i))
    parts, out = {p for p, *_ in fails}, {}
    shapley = dict.fromkeys(itertools.product(parts, "ABCDE"), 0)
    for order in map("".join, itertools.permutations("ABCDE")):
        for p in parts:
            left = [f for f in fails if f[0] == p]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                mine = [f for f in fails if f[0] == p and x in f[1]]
                out[p, order, step] = [len(left), len(gone), len(mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] in good for f in gone), sum(f[2] in toxic for f in gone)]
                shapley[p, x] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_a_plain_one(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    for i in range(300):  # copies within and across tasks, repeated ids, null ids, several signs
        text = rng.choice(["Aa bb", "same " * 60, " ".join(f"w{k}" for k in range(60)), "ONE TWO", "a # b", "", None, "é" * 30 + "AB"])
        rows.append((rng.choice([None, i % 40, 1000 + i]), text, rng.choice(["s0", "", None, "hot", "hot"])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(40), *range(1000, 1300)] for _ in range(rng.randint(0, 2))] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, source string, mask int, part string").repartition(7)
    df = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert audited(audit.audit(docs, df)) == plain_audit(rows, labels)
    assert audit.audit(no_docs, df).count() == 0
    assert audited(audit.audit(docs, df.limit(0))) == plain_audit(rows, [])


def test_equal_hashes_are_chains(monkeypatch):
    """With one hash for all texts, full texts still tell them apart, and entries that a full task sends on are merged behind the shuffle."""
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda raw: 5)
    monkeypatch.setattr(audit, "HELD", 1200)
    rows = [(9, "x", "p"), (3, "x", "p"), (4, "y", "q"), (4, "y", "q"), (7, "y", "p"), (1, "x", "q"), (None, "x", "p"), (8, "z", "p")] * 2
    sent = sorted(audit._route(iter(rows)), key=lambda kv: kv[0])
    assert sum(isinstance(x[0], bytes) for _, x in sent) > 3
    got = {}
    for i, part, mask, n in audit._judge(iter(sent)):
        got[i, part, mask >> 4] = got.get((i, part, mask >> 4), 0) + n
    assert got == {(9, "p", 1): 2, (3, "p", 1): 2, (4, "q", 0): 4, (7, "p", 1): 2, (1, "q", 0): 2, (None, "p", 0): 2, (8, "p", 0): 2}


def test_words_of_a_long_text_are_counted_in_slices(monkeypatch):
    text = ("ab cd\x0bef\n" * 5000 + "longword" * 400 + " end").encode()
    whole = audit.words(text)
    monkeypatch.setattr(audit, "_SLICE", 100)
    assert audit.words(text) == whole == (15002, 5)


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) in order of id."""
    x = np.array([np.floor(1024 * np.array(v, np.float64)) for _, v, _ in rows]).astype(np.int64)
    x = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = x[:, :entries].copy()
    nearest = lambda p: ((x[p][:, None] - books[p]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p).argmin(1)
            for e in set(own.tolist()):
                books[p, e] = x[p][own == e].sum(0) // (own == e).sum()
    d = [nearest(p) for p in range(parts)]
    error = sum(y.min(1) for y in d)
    by = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        by[label] = by.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{int(y[i].argmin()):02x}" for y in d), int(error[i]), by[r[2]], sha) for i, r in enumerate(rows)]


def coded(df, **how):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.coded(codes.compress(df, **how)).collect()), key=repr)


def test_codes_against_a_full_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 700)] + rng.normal(size=(700, 16)) * 0.05).astype(np.float32)
    x[100:140] = x[3]  # repeated entries among the first 256: ties go to the lower index
    x[400:450] = -x[5]
    rows = [(i - 50, [float(v) for v in r], None if i % 7 == 0 else int(i % 3)) for i, r in enumerate(x)]
    odd = [(5000, None, 1), (5001, [None] + [1.0] * 15, 1), (5002, [float("nan")] * 16, 1), (5003, [float("-inf")] + [0.0] * 15, None)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows + odd], "vec_id bigint, embedding array<float>, label int, own string, error int").repartition(5)
    assert coded(df) == sorted(plain_codes(rows), key=repr)
    # labels beyond the bound of a broadcast
    got = codes.compress(df)
    many = codes.with_label_errors(got.rows, most=1)
    assert many.count() == 700 and {r.label: r.label_error for r in many.collect()} == {r.label: r.label_error for r in codes.with_label_errors(got.rows).collect()}


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i), 0.5, -0.25, i / 3], None) for i in range(5)]
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id bigint, embedding array<double>")
    assert coded(df) == sorted(plain_codes(rows), key=repr)
    assert coded(df.limit(0)) == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(df.unionByName(spark.createDataFrame([(9, [1.0])], df.schema)))
    with pytest.raises(OverflowError, match="62 bits"):
        codes.compress(spark.createDataFrame([(9, [1e9] * 4)], df.schema))


def test_null_and_repeated_ids_of_vectors(spark):
    rows = [(None, [1.0] * 4, 1), (2, [3.0] * 4, 1), (2, [2.0] * 4, 1), (2, [2.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    ordered = [rows[2], rows[3], rows[1], rows[0]]
    assert coded(df) == sorted(plain_codes(ordered), key=repr)


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(3)
    c = rng.integers(-500, 500, (64, 8))
    x = c[rng.integers(0, 64, 2000)] + rng.integers(-40, 40, (2000, 8))
    d2 = codes.squared(x, c)
    assert (d2 == ((x[:, None] - c) ** 2).sum(2)).all()
    own, upper, lower = d2.argmin(1), codes._above(d2.min(1)), codes._below(d2)
    worked = 0
    for _ in range(3):
        new = c + rng.integers(-15, 15, c.shape)
        half, move = codes._below(codes.squared(new, new)) // 2, codes._above(((new - c) ** 2).sum(1))
        own, upper, lower, done = codes.elkan_step(x, new, half, move, own.copy(), upper, lower)
        exact = ((x[:, None] - new) ** 2).sum(2)
        assert (own == exact.argmin(1)).all()
        assert (lower**2 <= exact).all() and (upper**2 >= exact.min(1)).all()
        c, worked = new, worked + done
    assert worked < 0.2 * 3 * exact.size


# --- document fingerprints


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_fingerprints_against_a_plain_version(spark, odd_docs, no_docs):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) + "éß陷" * (i % 3)) for i in range(200)]
    rows += [(77, f"{i} hot " + "a b c d e f g " * i) for i in range(60)]  # an id that fills several buckets
    rows += [(None, f"{i} none at all") for i in range(40)] + [(500, "again and again")] * 30
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, bucket string, copies int").repartition(6)
    th = {t: h for t, h in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, -(d[0] or 0), th[d[1]], d[1]))
    want, sets = {}, {}
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] = (t, edited, nxt)
    found = sketches.edited_fingerprints(df).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in found} == set(want)
    prints, off = {}, []
    for r in found:
        t, edited, nxt = want[r.doc_id, r.n_chars, r.edited_sha256]
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        a, b, c = (sets.setdefault(x, shingles(x)) for x in (t, edited, nxt))
        if len(a) > 150 and len(b) > 150:
            off.append(abs(r.near_edited - len(a & b) / len(a | b)))
            assert abs(r.held_by_edited - len(a & b) / len(a)) < 0.25 and abs(r.near_next - len(a & c) / len(a | c)) < 0.2
    assert np.mean(off) < 0.06 and max(off) < 0.25
    heard = {k: tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k))) for k in prints}
    assert len(set(prints.values())) == len(set(heard.values()))  # no two word sequences share a fingerprint
    assert sketches.edited_fingerprints(no_docs).count() == 0
    one = sketches.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()


def test_a_long_text_is_read_in_slices(monkeypatch):
    text = " ".join(f"W{i * 7919 % 5003}" for i in range(20_000)) + " end"
    [whole] = sketches.fingerprints([text])
    monkeypatch.setattr(sketches, "_BATCH", 1000)
    assert sketches.fingerprints([text, "a b"])[0] == whole
    few = "x " * 3000 + "y"  # slices without a whole shingle in them
    monkeypatch.setattr(sketches, "_BATCH", 5)
    sliced = sketches.fingerprints([few, "one  " + " " * 20 + "two", " " * 30, ""])
    monkeypatch.undo()
    assert sliced == sketches.fingerprints([few, "one two", "", ""])


def test_sketches_merge_and_tell_containment(spark):
    rng = random.Random(5)
    word = lambda k: " ".join(rng.choices([f"w{i}" for i in range(3000)], k=k))
    small, rest = word(2000), word(60_000)
    a, b, both = sketches.fingerprints([small, rest, small + " " + rest])
    assert sketches.held(a, both) > 0.99 and sketches.alike(a, both) < 0.05
    merged = sketches.merge(a, b)
    assert abs(len(sketches.hashes_of(merged)) - len(sketches.hashes_of(both))) <= 8  # the shingles where they meet
    assert sketches.merge(a, a) == a and sketches.merge(a, b) == sketches.merge(b, a)
    df = sketches.with_fingerprint(spark.createDataFrame([(small, small + " " + rest), (None, "")], "text string, more string"))
    df = sketches.with_fingerprint(df, "other", "more").select(sketches.likeness(F.col("fingerprint"), F.col("other")).alias("l"), sketches.containment(F.col("fingerprint"), F.col("other")).alias("c"))
    (x, y) = df.collect()
    assert x.c > 0.99 and x.l < 0.05 and (y.l, y.c) == (1.0, 1.0)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_elkan_codes"])
def test_sql_agrees(spark, name):
    from serialloom.llm import queries

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in queries.queries()[name](spark, d).collect())
    assert mine == sorted(map(repr, want.select(*cols).fetchall()))
