"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's vector is the sum of the embeddings of its hash and of the hashes of
its first four, five and six bytes, so that inflected forms share most of it.
Filters of several widths slide over the words, each is max-pooled over the
whole text, and a logistic layer weighs the maxima. Training takes at most
``sample`` labelled texts of ``sample_bytes`` in all (by a hash of doc_id,
whole texts), so that the driver's memory is bounded; part of them
fixes where the score crosses 0.5 and the thresholds by language. A score
depends on the text alone; the language only picks the threshold behind
``toxic_by_lang``.

Edge cases: a null or empty text is scored as a run of padding; a null
``doc_id`` is never held out and has no label; labels that contradict each
other count as toxic; without labels of both classes every score is the share
of toxic labels (0 if there are none); languages with few toxic or clean
labels keep 0.5; repeated rows are scored each; an empty table gives an empty
result; further columns pass through, but for those that are named as the
results are, whose place these take.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import Words, mix, pack, pieces, unpack

PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class CnnParams:
    buckets: int = 1 << 16
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    sample: int = 12_000
    sample_bytes: int = 128 << 20
    epochs: int = 5
    batch: int = 32
    rate: float = 0.1
    seed: int = 5
    #: Toxic and clean labels that a language needs for a threshold of its own.
    least: int = 20


def features(text: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words by 1 + len(PREFIXES)) of all words, and the number of words of each text."""
    w = Words(text, lower=True)
    out = np.empty((len(w), 1 + len(PREFIXES)), np.uint32)
    out[:, 0] = w.hashes() % np.uint64(buckets)
    lane = w.lanes()
    for k, n in enumerate(PREFIXES):
        out[:, 1 + k] = mix((lane & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n)) % np.uint64(buckets)
    return out, np.diff(w.at)


class Cnn:
    def __init__(self, p: CnnParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.embed = rng.normal(0, 0.03, (p.buckets, p.dim)).astype(np.float32)
        self.conv = [rng.normal(0, 0.4, (w, p.dim, p.filters)).astype(np.float32) for w in p.widths]
        self.out = np.full(p.filters * len(p.widths), 0.3, np.float32)
        self.bias = np.float32(-2.0)
        self.scale, self.shift = 1.0, 0.0
        self.constant: float | None = None
        self.by_lang: dict[str, float] = {}

    def _padded(self, feats: np.ndarray, lens: np.ndarray):
        """Word vectors with max(widths) rows of padding behind each text, and where texts begin."""
        pad = max(self.p.widths)
        begin = np.concatenate([[0], np.cumsum(lens + pad)])
        x = np.zeros((int(begin[-1]), self.p.dim), np.float32)
        at = np.arange(len(feats)) + pad * np.repeat(np.arange(len(lens)), lens)
        total = self.embed[feats[:, 0]]
        for k in range(1, feats.shape[1]):
            total += self.embed[feats[:, k]]
        x[at] = total
        return x, begin, at

    def pooled(self, feats: np.ndarray, lens: np.ndarray, where: bool = False):
        x, begin, at = self._padded(feats, lens)
        tops, spots = [], []
        for w, c in zip(self.p.widths, self.conv, strict=True):
            y = x @ c[0]
            for o in range(1, w):
                y[:-o] += x[o:] @ c[o]
            # windows start at a text's words or at its first padding
            pad = max(self.p.widths)
            if pad > 1:
                for o in range(1, pad):
                    y[begin[1:] - o] = -np.inf
            tops.append(np.maximum.reduceat(y, begin[:-1], axis=0))
            if where:
                spots.append(np.stack([y[a:b].argmax(0) + a for a, b in zip(begin[:-1], begin[1:], strict=True)]))
        return np.hstack(tops), (x, at, spots)

    def logits(self, feats: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if not len(lens):
            return np.zeros(0)
        top, _ = self.pooled(feats, lens)
        return np.maximum(top, 0) @ self.out + self.bias

    def score(self, feats: np.ndarray, lens: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lens), self.constant)
        z = (self.logits(feats, lens).astype(np.float64) - self.shift) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, docs: list[np.ndarray], label: np.ndarray) -> None:
        """Adagrad on the logistic loss; only the windows that won a maximum pass a gradient on."""
        p, rng = self.p, np.random.default_rng(self.p.seed + 1)
        sums = {"embed": np.full(p.buckets, 1e-2, np.float32), "out": np.full(len(self.out), 1e-2, np.float32), "bias": np.float32(1e-2)}
        conv_sums = [np.full(c.shape, 1e-2, np.float32) for c in self.conv]
        weight = np.where(label == 1, min(5.0, max(1.0, float((label == 0).sum()) / max(1, (label == 1).sum()) / 2)), 1.0)
        for epoch in range(p.epochs):
            rate = p.rate / (1 + 0.5 * epoch)
            order = rng.permutation(len(docs))
            for a in range(0, len(order), p.batch):
                ids = order[a : a + p.batch]
                lens = np.array([len(docs[i]) for i in ids])
                feats = np.concatenate([docs[i] for i in ids])
                top, (x, at, spots) = self.pooled(feats, lens, where=True)
                act = np.maximum(top, 0)
                prob = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias, -30, 30)))
                err = ((prob - label[ids]) * weight[ids] / len(ids)).astype(np.float32)
                g_out, g_bias = act.T @ err, err.sum()
                g_top = err[:, None] * self.out[None, :] * (top > 0)
                back = np.full(len(x), -1)
                back[at] = np.arange(len(at))
                rows, grads = [], []
                for k, (w, c) in enumerate(zip(p.widths, self.conv, strict=True)):
                    g = g_top[:, k * p.filters : (k + 1) * p.filters]
                    spot = spots[k]
                    g_conv = np.zeros_like(c)
                    for o in range(w):
                        pos = np.minimum(spot + o, len(x) - 1)
                        g_conv[o] = np.einsum("nf,nfd->df", g, x[pos])
                        word = back[pos]
                        live = (word >= 0) & (g != 0)
                        rows.append(word[live])
                        grads.append((g[..., None] * c[o].T[None])[live])
                    conv_sums[k] += g_conv**2
                    c -= rate * 0.3 * g_conv / np.sqrt(conv_sums[k])
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                if len(rows):
                    hit = feats[rows].ravel()
                    own, place = np.unique(hit, return_inverse=True)
                    total = np.zeros((len(own), p.dim), np.float32)
                    np.add.at(total, place, np.repeat(grads, feats.shape[1], axis=0))
                    sums["embed"][own] += (total**2).sum(1)
                    self.embed[own] -= rate * total / np.sqrt(sums["embed"][own])[:, None]
                sums["out"] += g_out**2
                self.out -= rate * 0.3 * g_out / np.sqrt(sums["out"])
                sums["bias"] += g_bias**2
                self.bias -= rate * 0.3 * g_bias / np.sqrt(sums["bias"])


def cut_point(z: np.ndarray, label: np.ndarray) -> float:
    """Where to cut z for the best F1; between two values, in the middle of the gap."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + label.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1
    k = int(f1.argmax())
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def train(docs: list[np.ndarray], label: np.ndarray, lang: list[str | None], p: CnnParams) -> Cnn:
    model = Cnn(p)
    if len(set(label.tolist())) < 2:
        model.constant = float(label.mean()) if len(label) else 0.0
        return model
    rng = np.random.default_rng(p.seed + 2)
    tune = rng.random(len(docs)) < 0.15
    if len(set(label[tune].tolist())) < 2 or len(set(label[~tune].tolist())) < 2:
        tune = np.ones(len(docs), bool)
        fit = tune
    else:
        fit = ~tune
    model.fit([d for d, f in zip(docs, fit, strict=True) if f], label[fit])
    z = np.concatenate([model.logits(docs[i], np.array([len(docs[i])])) for i in np.flatnonzero(tune)]).astype(np.float64)
    y = label[tune]
    model.shift = cut_point(z, y)
    # steep enough that scores spread over 0 to 1 on either side of the cut
    model.scale = 4.0 / max(1e-3, float(np.median(np.abs(z - model.shift))))
    by = np.array([lang[i] or "" for i in np.flatnonzero(tune)])
    for name in set(by.tolist()):
        m = by == name
        if min((y[m] == 1).sum(), (y[m] == 0).sum()) >= p.least:
            t = (cut_point(z[m], y[m]) - model.shift) * model.scale
            model.by_lang[name] = float(1 / (1 + np.exp(-np.clip(t, -40, 40))))
    return model


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: A document of more than this part of ``sample_bytes`` is not learned from.
_SHARE = 16


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, params: CnnParams | None = None) -> Cnn:
    """Trains on labelled rows of ``docs`` whose crc32(doc_id as text) modulo ``modulus`` is not ``remainder``.

    The sample is bounded by rows and by bytes; documents that are a large part of the bytes alone are left out of it.
    Without labels the model knows nothing; with labels of which none could be taken, that is an error.
    """
    p = params or CnnParams()
    known = labels.select("doc_id", F.col("toxic").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id").limit(p.sample)
    texts = docs.select("doc_id", F.col("text").alias("text"), F.col("lang").alias("lang"))
    # no more than ``sample`` rows of two or three numbers
    sized = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"))
    # a document that is a large part of the bound by itself is left out, so that it does not displace the others
    fits = sized.filter(F.col("n") <= p.sample_bytes // _SHARE)
    before = F.sum("n").over(Window.orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id"))
    known = fits.withColumn("bytes", before).filter(F.col("bytes") <= p.sample_bytes).select("doc_id", "toxic")
    if known.isEmpty() and not sized.isEmpty():
        raise ValueError(f"no labelled document is short enough to learn from: sample_bytes is {p.sample_bytes}, and one of over a {_SHARE}th of that is left out")
    rows = texts.join(F.broadcast(known), "doc_id")

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            feats, lens = features(b.column("text"), p.buckets)
            cut = np.cumsum(lens)[:-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic").cast(pa.int32()), b.column("lang").cast(pa.string()), pa.array([pack(f.ravel()) for f in np.split(feats, cut)], pa.binary())], ["doc_id", "toxic", "lang", "words"])

    got = rows.mapInArrow(run, "doc_id bigint, toxic int, lang string, words binary").toArrow().sort_by("doc_id")
    packed = got.column("words").combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    raw = packed.buffers()[2]
    # views of the one table that came, not copies
    texts = [unpack(raw.slice(a, z - a)).reshape(-1, 1 + len(PREFIXES)) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    model = train(texts, np.asarray(got.column("toxic")).astype(np.int64).reshape(-1), got.column("lang").to_pylist(), p)
    del texts, packed, raw, got
    pa.default_memory_pool().release_unused()
    return model


def score_texts(docs: DataFrame, model: Cnn, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The rows of ``docs`` with held_out, score, predicted (score >= 0.5) and toxic_by_lang (the language's threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = ("held_out", "score", "predicted", "toxic_by_lang")
    passed = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    rows = docs.select(*passed, held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_by_lang", T.BooleanType())])

    def run(batches):
        model = sent.value
        for b in pieces(batches, "text", 1 << 20):
            feats, lens = features(b.column("text"), model.p.buckets)
            score = model.score(feats, lens)
            lang = b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * len(score)
            least = np.array([model.by_lang.get(x or "", 0.5) for x in lang])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= least)], [*b.schema.names, "score", "predicted", "toxic_by_lang"])

    return rows.mapInArrow(run, schema)
