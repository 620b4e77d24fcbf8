"""Nearest neighbours, chat formatting, mixing, toxicity, WARC and the language model."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from serialloom.llm import ann, chat, hmm, mixing, toxicity, warc


def vectors(spark, n=600, d=12):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[5] = x[6] = x[7]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(None, [1.0] * d, 1), (9001, None, 1), (9002, [], 1), (9003, [0.0] * d, 1), (9004, [float("nan")] * d, 1), (9005, [float("inf")] + [1.0] * (d - 1), 1), (9006, [None] + [1.0] * (d - 1), 1), (9020, [1.0], 1), (40, rows[40][1], 1)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int"), x


def test_nearest_neighbours(spark):
    df, x = vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 and v != q for _, v, s in found)
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(600), -score))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, -1.0])], "vec_id bigint, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_chats_read_back(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn:user>\n", "<turn+>", "\\", "\\t<\\turn", "", None, "é陷\n\n", "</turn", "x<"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", "assistant", "system", "us>er", None, "a\\>b", "assistant", "assistant", "<turn"], hard))]
    rows += [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "first"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chats.select("conv_id", "n_blocks", chat.read_back(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for t in got[c].t] == [(r or "", t or "") for _, _, r, t in own]
        assert got[c].l == "".join(t or "" for _, _, r, t in own if r == "assistant")
    assert got[2].n_blocks == 2 and got[1].n_blocks == 8
    assert chat.format_chats(df.limit(0)).count() == 0


def test_targets():
    assert mixing.targets([("b", 100), (None, 100), ("a", 100)]) == [("a", 100, 187.5), ("b", 100, 75.0), (None, 100, 37.5)]
    got = mixing.targets([("a", 10), ("b", 100), ("c", 1000)])
    assert got[0][2] == 30 and got[1][2] == 300 and math.isclose(sum(t for _, _, t in got), 1110)
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [("a", 0, 0.0)]


def test_permutations(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_mix(spark, odd_docs, no_docs):
    got = [tuple(r) for r in mixing.mix_sources(odd_docs, block=4, bucket_rows=3)["documents"].collect()]
    again = [tuple(r) for r in mixing.mix_sources(odd_docs.repartition(3), block=4, bucket_rows=3)["documents"].collect()]
    assert Counter(got) == Counter(again) and len(got) == odd_docs.count()
    by = {}
    for _, size, source_size, target, taken, source in got:
        assert 0 <= taken <= 3 * size
        s = by.setdefault(source, [0, 0, source_size, target])
        s[0] += size
        s[1] += taken
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 4 + 0.02 * target
    assert mixing.mix_sources(no_docs)["documents"].count() == 0


def test_mix_takes_whole_blocks(odd_docs):
    mix = mixing.mix_sources(odd_docs, block=16)
    used = mix["slots"].groupBy("src", "block").count()
    assert used.agg(F.max("count")).first()[0] <= 3
    want = mix["pieces"].join(used, ["src", "block"]).agg(F.sum(F.col("n") * F.col("count"))).first()[0]
    assert mix["documents"].agg(F.sum("taken")).first()[0] == want


def test_mixed_blocks_hold_what_was_taken(spark, texts):
    """Brute force: the words of every mixed block, told apart by their document."""
    rows = [(i, " ".join(f"{k}_{j}" for j in range(len((t or "").split()))), f"s{k % 3}") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = mixing.mix_sources(docs, block=16)
    blocks = mixing.mixed_blocks(docs, mix).collect()
    assert len(blocks) == mix["slots"].count() and max(len(b.text.split(" ")) for b in blocks) == 16
    by_doc, by_id, taken = Counter(int(w.split("_")[0]) for b in blocks for w in b.text.split(" ")), Counter(), Counter()
    for k, n in by_doc.items():
        by_id[rows[k][0]] += n
    for r in mix["documents"].collect():
        taken[r.doc_id] += r.taken
    assert by_id == +taken and sum(taken.values()) > 30_000


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 7)))
    rows, labels = [], []
    for i in range(600):
        t, toxic = [word() for _ in range(rng.integers(5, 60))], int(rng.random() < 0.25)
        if toxic:
            t[rng.integers(len(t))] = str(rng.choice(["zzscum", "zzidiot", "zzidiots"]))
        rows.append((i, " ".join(t), "en" if i % 2 else None))
        labels.append((i, toxic))
    rows += [(700, None, "en"), (701, "", None), (None, "zzscum x", "en"), (702, "zzscum " * 5000, "en")]
    labels += [(3, None), (None, 1), (9999, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    params = toxicity.CnnParams(buckets=4096, epochs=12)
    model = toxicity.learn(docs, labels, params=params)
    got = toxicity.score_texts(docs, model).join(labels.filter("doc_id < 600 AND toxic IS NOT NULL"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.toxic).mean() > 0.93
    rest = {r.doc_id: r for r in toxicity.score_texts(docs, model).filter("doc_id >= 700 OR doc_id IS NULL").collect()}
    assert len(rest) == 4 and all(0 <= r.score <= 1 for r in rest.values())
    assert rest[702].predicted == 1 and not rest[None].held_out
    assert rest[700].score == rest[701].score
    again = toxicity.learn(docs.repartition(3), labels, params=params)
    assert np.allclose(again.embed, model.embed)


def test_toxicity_beside_columns_of_the_same_names(spark, labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels, params=toxicity.CnnParams(buckets=256, epochs=1, sample=50, sample_bytes=4_000))
    odd = docs.withColumns({"Score": F.lit("x"), "predicted": F.lit(None), "toxic_by_lang": F.lit(3), "held_out": F.lit("y"), "more": F.lit(1)})
    out = toxicity.score_texts(odd, model)
    assert out.columns == ["doc_id", "text", "lang", "more", "held_out", "score", "predicted", "toxic_by_lang"] and out.count() == docs.count()


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_texts(docs, model).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_a_very_long_text_does_not_switch_learning_off(spark, labelled):
    docs, labels = labelled
    more = docs.unionByName(spark.createDataFrame([(i, f"only{i} " * 40_000, "en") for i in range(900, 930)], docs.schema))
    said = labels.unionByName(spark.createDataFrame([(i, 0) for i in range(900, 930)], labels.schema))
    model = toxicity.learn(more, said, params=toxicity.CnnParams(buckets=4096, epochs=12, sample_bytes=150_000))
    got = toxicity.score_texts(docs, model).join(labels.filter("doc_id < 600 AND toxic IS NOT NULL"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    with pytest.raises(ValueError, match="short enough"):
        toxicity.learn(docs, labels, params=toxicity.CnnParams(sample_bytes=16))


def test_pooling_is_a_plain_convolution():
    p = toxicity.CnnParams(buckets=64, dim=4, filters=3)
    m, rng = toxicity.Cnn(p), np.random.default_rng(0)
    lens = np.array([5, 0, 1, 9])
    feats = rng.integers(0, 64, (15, 4)).astype(np.uint32)
    top, _ = m.pooled(feats, lens)
    at = 0
    for row, n in zip(top, lens):
        x = np.vstack([m.embed[feats[at : at + n]].sum(1).reshape(n, 4), np.zeros((3, 4), np.float32)])
        want = [max(float(np.einsum("od,od->", x[s : s + w], m.conv[k][:, :, f])) for s in range(n + 1)) for k, w in enumerate(p.widths) for f in range(3)]
        assert np.allclose(row, want, atol=1e-5)
        at += n


def rows_of(spark, records):
    return spark.createDataFrame(records, "page_id bigint, url string, html string")


@pytest.fixture
def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    return rows_of(spark, [(1, "http://a/ b", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (1, "again", big), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (8, "u", "é" * 300_000)])


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(pages, tmp_path, compress):
    manifest = warc.write_archives(warc.decide(pages), f"file://{tmp_path}", compress)
    got = warc.read_archives(manifest)
    assert got.filter("kind = 'gap'").count() == 0
    told = Counter((r.headers["WARC-Record-ID"], r.headers["WARC-Type"], r.headers.get("WARC-Refers-To"), bytes(r.payload)) for r in got.collect())
    want = Counter()
    for r in pages.collect():
        raw = (r.html or "").encode()
        again = len(raw) >= 100 and raw.startswith(b"<p>") and r.page_id != 1
        want[f"<urn:page:{r.page_id}>", "revisit" if again else "response", "<urn:page:1>" if again else None, b"" if again else raw] += 1
    assert told == want


def archive(n, compress):
    out = []
    for i in range(n):
        payload = f"<html>{i} {'y' * 50 * i}</html>".encode()
        raw = warc.record({"page_id": i, "url": "u", "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "record_type": "response", "refers_to": None})
        if compress:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress(raw) + z.flush()
        out.append(raw)
    return out


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "head", "tail"])
def test_salvage(compress, harm):
    parts = archive(8, compress)
    where = sum(map(len, parts[:3]))
    if harm == "flip":
        p = bytearray(parts[3])
        p[len(p) // 2] ^= 0x55
        parts[3] = bytes(p)
    elif harm == "cut":
        parts[3] = parts[3][: len(parts[3]) // 2]
    elif harm == "junk":
        parts.insert(3, b"\x00garbage WARC/1.1 and \x1f\x8b\x08 junk")
    elif harm == "head":
        parts.insert(0, b"??")
    else:
        parts[-1] = parts[-1][:-20]
    raw = b"".join(parts)
    got = list(warc.read_records(io.BytesIO(raw)))
    gaps = [g for g in got if g["kind"] == "gap"]
    ids = [int(r["headers"]["WARC-Record-ID"].split(":")[-1][:-1]) for r in got if r["kind"] == "record"]
    lost = {"flip": [3], "cut": [3], "junk": [], "head": [], "tail": [7]}[harm]
    assert ids == [i for i in range(8) if i not in lost]
    assert len(gaps) == 1 and sum(g["length"] for g in got) == len(raw)
    assert gaps[0]["offset"] == {"head": 0, "tail": sum(map(len, parts[:-1]))}.get(harm, where)
    assert list(warc.read_records(io.BytesIO(b""))) == []


class Counted(io.BytesIO):
    most = 0

    def read(self, n=-1):
        self.most = max(self.most, n)
        return super().read(n)


def test_plain_archives_are_read_in_chunks():
    """An archive of many records, and one with long damage: no more than a few chunks are held."""
    parts = archive(8, False)
    for raw, n in ((b"".join(parts) * 4000, 32_000), (b"?" * (40 << 20) + parts[0] + b"!" * (20 << 20) + parts[1], 2)):
        src = Counted(raw)
        held, drop = 0, warc.Source.drop
        sizes = []
        warc.Source.drop = lambda self, at: (sizes.append(len(self.buf)), drop(self, at))[1]
        try:
            got = [r["kind"] for r in warc.read_records(src, len(raw))]
        finally:
            warc.Source.drop = drop
        assert got.count("record") == n and max(sizes) <= 3 << 20 and src.most <= 2 << 20, (held, max(sizes))


def test_a_length_beyond_the_archive_is_damage():
    parts = archive(3, False)
    raw = parts[0] + re.sub(rb"Content-Length: \d+", b"Content-Length: 99999999999", parts[1]) + parts[2]
    src = Counted(raw)
    got = [(r["kind"], r.get("reason")) for r in warc.read_records(src, len(raw))]
    assert got == [("record", None), ("gap", "block's length"), ("record", None)]


def test_a_gap_fails_the_round_trip_and_revisits_follow_their_response(spark, pages, tmp_path):
    manifest = warc.write_archives(warc.decide(pages), f"file://{tmp_path}", False)
    read = warc.read_archives(manifest)
    rows = warc.payloads(read).collect()
    assert len(rows) == pages.count() and {r.record_type for r in rows} == {"response", "revisit"}
    name = manifest.orderBy(F.desc("records")).first().archive.removeprefix("file://")
    raw = bytearray(open(name, "rb").read())
    raw[raw.index(b"WARC-Type") - 5] ^= 0xFF
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="damaged bytes in"):
        warc.payloads(read).count()


def test_warc_of_nothing(pages, tmp_path):
    assert warc.read_archives(warc.write_archives(warc.decide(pages.limit(0)), f"file://{tmp_path}")).count() == 0


def plain_forward(sym, start, move, ratio):
    v = start * ratio[sym[0]]
    for s in sym[1:]:
        v = (v @ move) * ratio[s]
    return math.log(v.sum())


def plain_counts(sym, start, move, ratio):
    s, n = len(start), len(sym)
    a = [start * ratio[sym[0]]]
    for t in range(1, n):
        a.append((a[-1] @ move) * ratio[sym[t]])
    b = [np.ones(s)]
    for t in range(n - 1, 0, -1):
        b.insert(0, move @ (ratio[sym[t]] * b[0]))
    total = a[-1].sum()
    counts, moves = np.zeros(ratio.shape), np.zeros((s, s))
    for t in range(n):
        counts[sym[t]] += a[t] * b[t] / total
        if t:
            moves += np.outer(a[t - 1], ratio[sym[t]] * b[t]) * move / total
    return counts, moves, a[0] * b[0] / total


def test_forward_and_expected_counts_are_exact():
    rng = np.random.default_rng(3)
    s, k = 3, 11
    start, move, ratio = rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.uniform(0.2, 3, (k, s))
    lens = np.array([1, 2, 127, 128, 129, 300, 40])
    sym = rng.integers(0, k, lens.sum())
    docs = np.split(sym, np.cumsum(lens)[:-1])
    got = hmm.boundaries(sym, hmm.Segments(lens), start, move, ratio)[2]
    assert np.allclose(got, [plain_forward(d, start, move, ratio) for d in docs])
    counts, moves, starts, total = hmm.expected(sym, lens, start, move, ratio)
    want = [plain_counts(d, start, move, ratio) for d in docs]
    assert np.allclose(counts, sum(w[0] for w in want)) and np.allclose(moves, sum(w[1] for w in want)) and np.allclose(starts, sum(w[2] for w in want))
    assert np.isclose(total, got.sum())


def test_language_model(spark, odd_docs, texts, no_docs):
    params = hmm.HmmParams(states=2, symbols=256, schedule=((3, 1.0),))
    got = [r for r in hmm.score_corpus(odd_docs, params=params).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None]) for i, t in texts]
    count = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(t), sum(w in count for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.score_corpus(no_docs, params=params).count() == 0


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(5)
    two = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(two[i % 2], 80)), 0) for i in range(120)], "doc_id bigint, text string, n int")
    got = hmm.score_corpus(docs, params=hmm.HmmParams(states=2, symbols=1024, schedule=((12, 1.0),), prior=5.0)).toPandas()
    held = got[got.held_out]
    assert len(held) > 5 and (held.score > held.base_score + 10).all()


def test_hmm_rounds_run_over_all_training_texts(spark):
    """By default; texts whose ids are all null hash alike, so a share of them was none."""
    assert all(part == 1 for _, part in hmm.HmmParams().schedule)
    docs = spark.createDataFrame([(None, "a b " * 30) for _ in range(6)], "doc_id bigint, text string")
    assert all(abs(r.score - r.base_score) > 1e-3 for r in hmm.score_corpus(docs).collect())
