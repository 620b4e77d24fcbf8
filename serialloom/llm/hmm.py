"""Hidden Markov language model: trained by Baum-Welch over all training texts, scored by the scaled forward recursion.

Words are too many to give each a row of every state's emission table, so a
state emits one of ``symbols`` hash classes of words, and a class emits its
words by their smoothed corpus frequency. The text's log10 probability is then
the unigram ``base_score`` plus the log10 of the forward likelihood of ratios
``P(class | state) / P(class)``; the tables stay the same size whatever the
corpus, while word counts are exact and live only in shuffled blocks.

Sequences are cut into segments. The transfer matrices of all segments of a
piece are multiplied side by side, and the boundary vectors that follow from
them are those of the plain recursion, so that likelihoods and expected counts
are exact for a text of any length.

Edge cases: a null text is an empty one (its only token is the end token); a
null ``doc_id`` trains and is never held out; rows that repeat a ``doc_id``
are scored each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .tokens import Words, mix, pack, pieces, unpack

END = np.uint64(0x1E3D5C7B9A0F1E2D)
SEGMENT = 128
BLOCK = 1024
_TOKENS = "piece string, doc_ids array<bigint>, held binary, lens binary, words binary, tokens binary"
_PIECE_BYTES = 2 << 20
#: Tokens that the recursions run over at once; only a longer text takes more.
_RUN = 1 << 16


@dataclass(frozen=True)
class HmmParams:
    states: int = 4
    symbols: int = 1 << 15
    #: Iterations and the share of training texts (by a hash of doc_id) that each runs over.
    schedule: tuple[tuple[int, float], ...] = ((8, 1.0),)
    prior: float = 200.0
    seed: int = 7


def tokenise(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Pieces of a few thousand texts: their ids, lengths, distinct word hashes and each token's place among these."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = docs.select("doc_id", F.col("text").alias("text"), F.coalesce(crc == remainder, F.lit(False)).alias("held"))

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for b in pieces(batches, "text", _PIECE_BYTES):
            w = Words(b.column("text"), lower=True)
            n = np.diff(w.at)
            h = np.insert(w.hashes(), w.at[1:], END)
            words, tokens = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "piece": [f"{part}-{k}"],
                    "doc_ids": pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": [np.asarray(b.column("held").cast(pa.int8())).astype(np.uint8).tobytes()],
                    "lens": [pack(n + 1)],
                    "words": [words.tobytes()],
                    "tokens": [pack(tokens)],
                }
            )
            k += 1

    return rows.mapInArrow(run, _TOKENS)


class Piece:
    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.lens = unpack(row["lens"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"])
        self.first = np.concatenate([[0], np.cumsum(self.lens)])

    def classes(self, symbols: int) -> np.ndarray:
        return (mix(self.words) % np.uint64(symbols)).astype(np.int64)

    def share(self, part: float) -> np.ndarray:
        ids = np.array([-1 if x is None else x for x in self.doc_ids], np.int64).astype(np.uint64)
        return (mix(ids + np.uint64(11)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def count_words(tokens: DataFrame, blocks: int) -> DataFrame:
    """For each block of word hashes: the training counts that each piece asks for, in the order of its words.

    A piece sends a word once, with its count in the piece, so that a frequent word weighs no more than a rare one.
    """

    def send(batches):
        for row in _rows(batches):
            p = Piece(row)
            train = np.repeat(~p.held, p.lens)
            n = np.bincount(p.tokens[train], minlength=len(p.words))
            cut = np.searchsorted(p.words, (np.arange(blocks + 1, dtype=object) * (1 << 64) // blocks)[:-1].astype(np.uint64))
            cut = np.append(cut, len(p.words))
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "piece": [row["piece"]], "words": [p.words[s].tobytes()], "n": [pack(n[s])]})

    def total(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        n = np.concatenate([unpack(x).astype(np.int64) for x in table.column("n").to_pylist()])
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(place, weights=n, minlength=len(known)).astype(np.int64)
        out, at = [], 0
        for w in words:
            out.append(pack(count[place[at : at + len(w)]]))
            at += len(w)
        seen = known[count > 0]
        more = pa.array([seen.tobytes(), pack(count[count > 0])], pa.binary())
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * (len(out) + 1), pa.int32()),
                "piece": pa.array(table.column("piece").to_pylist() + [None], pa.string()),
                "words": pa.array([None] * len(out) + [more[0].as_py()], pa.binary()),
                "n": pa.array(out + [more[1].as_py()], pa.binary()),
            }
        )

    sent = tokens.mapInArrow(send, "block int, piece string, words binary, n binary")
    return sent.groupBy("block").applyInArrow(total, "block int, piece string, words binary, n binary")


def class_masses(counts: DataFrame, symbols: int) -> tuple[int, int, np.ndarray]:
    """Training tokens, distinct words, and for each class the sum of its words' counts plus one."""

    def run(batches):
        n = v = 0
        mass = np.zeros(symbols)
        for b in batches:
            for w, c in zip(b.column("words").to_pylist(), b.column("n").to_pylist(), strict=True):
                w, c = np.frombuffer(w, np.uint64), unpack(c)
                n, v = n + int(c.sum()), v + len(w)
                mass += np.bincount((mix(w) % np.uint64(symbols)).astype(np.int64), weights=c + 1.0, minlength=symbols)
        for k in range(0, symbols, BLOCK):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k // BLOCK], pa.int32()), "n": [n if not k else 0], "v": [v if not k else 0], "mass": [mass[k : k + BLOCK].tobytes()]})

    def total(t: pa.Table) -> pa.Table:
        mass = np.sum([np.frombuffer(x) for x in t.column("mass").to_pylist()], axis=0)
        return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.int32()), "n": [pc.sum(t.column("n")).as_py()], "v": [pc.sum(t.column("v")).as_py()], "mass": [mass.tobytes()]})

    schema = "k int, n bigint, v bigint, mass binary"
    rows = counts.filter(F.col("piece").isNull()).select("words", "n").mapInArrow(run, schema).groupBy("k").applyInArrow(total, schema).collect()
    mass = np.zeros(symbols)
    for r in rows:
        mass[r.k * BLOCK : r.k * BLOCK + BLOCK] = np.frombuffer(r.mass)
    return sum(r.n for r in rows), sum(r.v for r in rows), mass


def runs(lens: np.ndarray, most: int = _RUN):
    """Slices of texts and of their tokens: as many texts as hold ``most`` tokens, or a single one."""
    ends = np.cumsum(lens)
    a = 0
    while a < len(lens):
        base = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield slice(a, z), slice(base, int(ends[z - 1]))
        a = z


class Segments:
    """Texts, as runs of symbols one behind the other, cut into segments of at most SEGMENT symbols, longest first."""

    def __init__(self, lens: np.ndarray):
        per = -(-lens // SEGMENT)
        doc = np.repeat(np.arange(len(lens)), per)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(np.cumsum(lens) - lens, per) + place * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lens, per) - place * SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.doc, self.place, self.start, self.size = doc[order], place[order], start[order], size[order]
        self.active = [int((self.size > t).sum()) for t in range(int(self.size[0]) if len(doc) else 0)]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ends = np.cumsum(per)
        #: by place: the segments (in our order) that hold this place, and their texts
        by = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by], np.arange(int(per.max()) + 1 if len(per) else 1))
        self.by_place = [(back[by[a:b]], doc[by[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.last = back[ends - 1] if len(per) else np.zeros(0, np.int64)
        self.docs = len(lens)


def boundaries(sym: np.ndarray, seg: Segments, start: np.ndarray, move: np.ndarray, ratio: np.ndarray):
    """The scaled forward vector before, and the backward vector behind each segment, and each text's log likelihood.

    Arrays hold a column for each segment, so that sums over states add whole rows.
    """
    n, s = len(seg.doc), len(start)
    table, go = np.ascontiguousarray(ratio.T), np.ascontiguousarray(move.T)
    prod, log = np.broadcast_to(np.eye(s)[:, :, None], (s, s, n)).copy(), np.zeros(n)
    first = seg.place == 0
    for t, m in enumerate(seg.active):
        b = table.take(sym[seg.start[:m] + t], axis=1)
        if t == 0:
            new = np.where(first[:m], start[None, :, None], move[:, :, None]) * b
        else:
            new = np.matmul(go, prod[:, :, :m])
            new *= b
        if t % 8 == 7:
            top = new.max(axis=(0, 1))
            new /= top
            log[:m] += np.log(top)
        if m == n:
            prod = new
        else:
            prod[:, :, :m] = new
    before, behind = np.empty((s, n)), np.ones((s, n))
    v, total = np.full((s, seg.docs), 1.0 / s), np.zeros(seg.docs)
    for rows, docs in seg.by_place:
        before[:, rows] = was = v[:, docs]
        new = (was[:, None, :] * prod[:, :, rows]).sum(0)
        scale = new.sum(0)
        total[docs] += np.log(scale) + log[rows]
        v[:, docs] = new / scale
    w = np.ones((s, seg.docs))
    for rows, docs in reversed(seg.by_place):
        behind[:, rows] = was = w[:, docs]
        new = (prod[:, :, rows] * was[None]).sum(1)
        w[:, docs] = new / new.sum(0)
    return before, behind, total


def expected(sym: np.ndarray, lens: np.ndarray, start, move, ratio):
    """Expected counts of symbols by state, of moves and of first states, and the log likelihood."""
    seg = Segments(lens)
    s = len(start)
    before, beta, total = boundaries(sym, seg, start, move, ratio)
    first = seg.place == 0
    table, go = np.ascontiguousarray(ratio.T), np.ascontiguousarray(move.T)
    alphas, emits, v = [], [], before
    for t, m in enumerate(seg.active):
        b = table.take(sym[seg.start[:m] + t], axis=1)
        v = go @ v[:, :m]
        if t == 0:
            v = np.where(first[:m], start[:, None], v)
        v *= b
        v /= v.sum(0)
        alphas.append(v)
        emits.append(b)
    gamma = np.empty((s, len(sym)))
    moves, starts = np.zeros((s, s)), np.zeros(s)
    for t in range(len(seg.active) - 1, -1, -1):
        m = seg.active[t]
        g = alphas[t] * beta[:, :m]
        g /= g.sum(0)
        gamma[:, seg.start[:m] + t] = g
        ahead = emits.pop()
        ahead *= beta[:, :m]
        back = move @ ahead
        was = alphas[t - 1][:, :m] if t else before
        was = was / (was * back).sum(0)
        if t == 0:
            starts += g[:, first].sum(1)
            moves += was[:, ~first] @ ahead[:, ~first].T
        else:
            moves += was @ ahead.T
        beta[:, :m] = back / back.sum(0)
    counts = np.stack([np.bincount(sym, weights=g, minlength=len(ratio)) for g in gamma], 1)
    return counts, moves * move, starts, float(total.sum())


def baum_welch(tokens: DataFrame, mass: np.ndarray, unseen: float, p: HmmParams):
    """Start and move probabilities and the emission ratios, from expected counts summed over all partitions."""
    rng = np.random.default_rng(p.seed)
    s, q = p.states, mass * (1 - unseen)
    start, move = np.full(s, 1 / s), np.full((s, s), 0.1 / max(1, s - 1)) if s > 1 else np.ones((1, 1))
    if s > 1:
        np.fill_diagonal(move, 0.9)
    if not mass.any():  # nothing to learn from
        return start, move, np.ones((len(q), s))
    emit = q[:, None] * rng.uniform(0.5, 1.5, (len(q), s))
    emit *= (1 - unseen) / emit.sum(0)
    sc = tokens.sparkSession.sparkContext
    for rounds, part in p.schedule:
        for _ in range(rounds):
            ratio = np.divide(emit, q[:, None], out=np.ones_like(emit), where=q[:, None] > 0)
            sent = sc.broadcast((start, move, ratio))

            def run(batches, sent=sent, part=part):
                start, move, ratio = sent.value
                c, m, f, total = np.zeros(ratio.shape), np.zeros(move.shape), np.zeros(len(start)), 0.0
                for row in _rows(batches):
                    piece = Piece(row)
                    take = ~piece.held & (piece.share(part) if part < 1 else True)
                    if take.any():
                        sym = piece.classes(len(ratio))[piece.tokens[np.repeat(take, piece.lens)]]
                        lens = piece.lens[take]
                        for texts, at in runs(lens):
                            a, b, d, e = expected(sym[at], lens[texts], start, move, ratio)
                            c += a
                            m, f, total = m + b, f + d, total + e
                for k in range(0, len(ratio), BLOCK):
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k // BLOCK], pa.int32()), "x": [c[k : k + BLOCK].tobytes()]})
                yield pa.RecordBatch.from_pydict({"k": pa.array([-1], pa.int32()), "x": [np.concatenate([m.ravel(), f, [total]]).tobytes()]})

            def add(t: pa.Table) -> pa.Table:
                x = np.sum([np.frombuffer(v) for v in t.column("x").to_pylist()], axis=0)
                return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.int32()), "x": [x.tobytes()]})

            got = {r.k: np.frombuffer(r.x) for r in tokens.mapInArrow(run, "k int, x binary").groupBy("k").applyInArrow(add, "k int, x binary").collect()}
            sent.destroy()
            if not got:
                return start, move, np.ones_like(emit)
            c = np.concatenate([got[k] for k in range(-(-len(q) // BLOCK))]).reshape(-1, s)
            m, f = got[-1][: s * s].reshape(s, s), got[-1][s * s : -1]
            move = (m + 1.0) / (m + 1.0).sum(1, keepdims=True)
            start = (f + 1.0) / (f + 1.0).sum()
            emit = (c + p.prior * q[:, None]) / (c.sum(0) + p.prior)
            emit *= (1 - unseen) / emit.sum(0)
    return start, move, np.divide(emit, q[:, None], out=np.ones_like(emit), where=q[:, None] > 0)


def score_corpus(docs: DataFrame, modulus: int = 7, remainder: int = 2, params: HmmParams | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row of ``docs``.

    Word counts and Baum-Welch take the rows whose crc32(doc_id as text) modulo ``modulus`` is not ``remainder``.
    """
    p = params or HmmParams()
    spark = docs.sparkSession
    tokens = keep(tokenise(docs, modulus, remainder), "tokens")
    blocks = max(8, 2 * tokens.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    counts = keep(count_words(tokens, blocks), "counts")
    n, v, mass = class_masses(counts, p.symbols)
    unseen = 1.0 / (n + v + 1)
    mass = mass / max(mass.sum(), 1.0)
    start, move, ratio = baum_welch(tokens, mass, unseen, p)
    sent = spark.sparkContext.broadcast((start, move, np.vstack([ratio, np.ones((1, p.states))])))
    asked = counts.filter(F.col("piece").isNotNull()).groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("asked"))

    def run(batches):
        start, move, ratio = sent.value
        for row in _rows(batches):
            piece = Piece(row)
            c = np.concatenate([unpack(x["n"]).astype(np.float64) for x in row["asked"]])
            sym = piece.classes(len(ratio) - 1)
            sym[c == 0] = len(ratio) - 1
            logs = np.log10((c + 1) / (n + v + 1))
            base = np.add.reduceat(logs[piece.tokens], piece.first[:-1])
            known = np.add.reduceat((c > 0)[piece.tokens].astype(np.int64), piece.first[:-1])
            sym = sym[piece.tokens]
            total = np.concatenate([boundaries(sym[at], Segments(piece.lens[texts]), start, move, ratio)[2] for texts, at in runs(piece.lens)])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(piece.doc_ids, pa.int64()),
                    "held_out": piece.held,
                    "n_tokens": piece.lens,
                    "n_known": known,
                    "train_tokens": np.full(len(known), n),
                    "base_score": base,
                    "score": base + total / np.log(10),
                }
            )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return tokens.join(asked, "piece").mapInArrow(run, schema)
