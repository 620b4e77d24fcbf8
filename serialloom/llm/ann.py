"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are lifted by one coordinate that makes them equally long, so that the
largest inner product is the smallest angle; rotations learned on a bounded
sample (``sample`` vectors, by a hash of their id) turn them into codes of
``bits`` bits, each the sign of a rotated coordinate. A code is split into
substrings, and each block of candidates keeps an inverted list per substring.
A code within ``radius`` bits of a query's agrees with it up to
``radius // substrings`` bits in one substring at least, so probing the lists
of all such keys retrieves every code within the radius; what passes the full
Hamming distance is ranked by the float vectors in double precision.

The radius is learned too: it holds ``recall`` of the sample's true neighbours
in the sample, which are farther away than those in the whole table. A query
that finds fewer than ``k`` is searched again without a radius.

Queries go out in broadcasts of about ``query_block`` vectors each; candidates
stay where they are read, and each task sends ``k`` rows a query at most.

Edge cases: vectors that are null, empty, zero or hold a null or a number that
is not finite take no part, nor do rows with a null id or vectors not as long
as most are; equal scores go by the smaller id; rows that repeat a query's id
are its own and no candidates; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

SUB = 8
ROWS = 8192
_SCHEMA = "query_id bigint, vec_id bigint, score double"


def usable(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Coder:
    """Rotations found by iterative quantisation, one for each 64 bits."""

    def __init__(self, sample: np.ndarray, top: float, bits: int, seed: int = 3, steps: int = 12):
        self.top = top
        x = self.lift(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        rng = np.random.default_rng(seed)
        self.turns = []
        for _ in range(bits // 64):
            axes = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
            if x.shape[1] < 64:  # too few dimensions: random directions make up the rest
                axes = np.hstack([axes, rng.normal(size=(x.shape[1], 64 - x.shape[1]))])
                self.turns.append(axes)
                continue
            if x.shape[1] > 65:
                _, _, vt = np.linalg.svd(x, full_matrices=False)
                axes = vt[:64].T @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
            w = axes[:, :64]
            for _ in range(steps):
                u, _, vt = np.linalg.svd(x.T @ np.sign(x @ w), full_matrices=False)
                w = u @ vt
            self.turns.append(w)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.top**2 - (x * x).sum(1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = np.hstack([x, np.zeros((len(x), 1))]) if query else self.lift(x)
        y = y - self.mean
        return np.hstack([np.packbits(y @ w > 0, axis=1, bitorder="little").view("<u8") for w in self.turns])


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def learn(x: np.ndarray, top: float, bits: int, k: int, recall: float, seed: int = 3) -> tuple[Coder, int]:
    """The coder, and the radius that holds ``recall`` of the true neighbours of some of the sample."""
    coder = Coder(x, top, bits, seed)
    codes = coder.codes(x)
    some = np.random.default_rng(seed).permutation(len(x))[:256]
    scale = np.sqrt((x[some] ** 2).sum(1, keepdims=True))
    asked = coder.codes(x[some] / scale * top, query=True)
    far = []
    for i, q, c in zip(some, x[some], asked, strict=True):
        s = x @ q
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1))[:k]
        far.append(_hamming(codes[near[near != i]], c[None]))
    far = np.concatenate(far) if far else np.zeros(0)
    return coder, int(np.ceil(np.quantile(far, recall))) if len(far) else bits


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int):
    order = np.lexsort((vec, -score, query))
    q, v, s = query[order], vec[order], score[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    take = place < k
    return q[take], v[take], s[take]


class Index:
    """One block's inverted lists: for each substring the rows by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        keys = codes.view(np.uint8).reshape(len(codes), -1)
        self.order = [np.argsort(keys[:, j], kind="stable") for j in range(keys.shape[1])]
        self.cuts = [np.searchsorted(keys[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.seen: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, j: int, key: int, reach: int) -> np.ndarray:
        """A mask of the rows whose substring j is at most ``reach`` bits from ``key``."""
        if (j, key, reach) not in self.seen:
            near = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(key)) <= reach)
            mask = np.zeros(len(self.codes), bool)
            for v in near.tolist():
                mask[self.order[j][self.cuts[j][v] : self.cuts[j][v + 1]]] = True
            self.seen[j, key, reach] = mask
        return self.seen[j, key, reach]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows within ``radius`` bits of ``code``."""
        keys = code.view(np.uint8)
        mask = self.probe(0, int(keys[0]), radius // len(keys)).copy()
        for j in range(1, len(keys)):
            mask |= self.probe(j, int(keys[j]), radius // len(keys))
        rows = np.flatnonzero(mask)
        return rows[_hamming(self.codes[rows], code[None]) <= radius]


def _search(base: DataFrame, sent, radius: int, k: int) -> DataFrame:
    def run(batches):
        ids, vectors, codes, coder = sent.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for whole in batches:
            for b in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
                x, vec = _matrix(b.column("v")), np.asarray(b.column("vec_id"))
                index, found = Index(coder.codes(x)), [held]
                for q, v, c in zip(ids, vectors, codes, strict=True):
                    rows = index.within(c, radius)
                    rows = rows[vec[rows] != q]
                    score = x[rows] @ v
                    if len(rows) > k:
                        take = score >= np.partition(score, -k)[-k]
                        rows, score = rows[take], score[take]
                    found.append((np.full(len(rows), q), vec[rows], score))
                held = best(*(np.concatenate(f) for f in zip(*found, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], ["query_id", "vec_id", "score"])

    met = base.mapInArrow(run, _SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 128, sample: int = 20_000, recall: float = 0.985, query_block: int = 16_384, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("asked"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dims = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.count_if("asked").alias("asked")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    own = own.filter(F.size("v") == dims["d"])
    drawn = own.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select("v")
    coder, radius = learn(_matrix(drawn.toArrow().column("v")), float(np.sqrt(dims["top"])) * (1 + 1e-9), bits, k, recall, seed)
    base = own.select("vec_id", "v")
    blocks = max(1, -(-dims["asked"] // query_block))
    out = []
    for i in range(blocks):
        part = own.filter("asked").filter(F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "vec_id"), F.lit(blocks)) == i).select("vec_id", "v")
        got = part.toArrow()  # about query_block rows

        def search(rows: np.ndarray, radius: int, got=got) -> DataFrame:
            x = _matrix(got.column("v"))[rows]
            ids = np.asarray(got.column("vec_id"))[rows]
            ids, first = np.unique(ids, return_index=True)
            x = x[first]
            codes = coder.codes(x / np.sqrt((x * x).sum(1, keepdims=True)) * coder.top, query=True)
            return keep(_search(base, spark.sparkContext.broadcast((ids, x, codes, coder)), radius, k), "near")

        found = search(np.arange(got.num_rows), radius)
        whole = found.filter(F.col("rank") == k).select("query_id").toArrow().column("query_id")
        short = np.flatnonzero(~np.isin(np.asarray(got.column("vec_id")), np.asarray(whole)))
        if len(short):
            ids = spark.createDataFrame([(int(x),) for x in np.unique(np.asarray(got.column("vec_id"))[short])], "query_id bigint")
            found = found.join(ids, "query_id", "left_anti").unionByName(search(short, bits))
        out.append(found)
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done
