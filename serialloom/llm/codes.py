"""Vector code compression: product codes learned by Lloyd's rounds with Elkan's bounds.

Components become whole numbers, floor(scale * x), and a vector is cut into
``parts`` equal runs. Each part position has a codebook that starts as the
parts of the first vectors by id; a round assigns every part to its nearest
entry (ties to the lower index) and moves each entry to the floored mean of
its parts. All distances that decide are whole numbers.

Between rounds a row keeps, for each part, its entry, an upper bound on the
distance to it and a lower bound on the distance to every entry, in whole units
rounded to the safe side. When entries move, bounds shift by that movement. An
entry is left out only if its lower bound, or half its distance to the own
entry, is *strictly* above the upper bound; all others, equal ones included,
are settled by exact squared distances. So the codes are those of a full search.

The state is a table (Parquet, in the shared folder) that each round reads and
writes; the driver holds the codebooks alone (parts x entries, a fixed size).
The bounds take two bytes an entry and part: 2 KB a vector with four codebooks
of 256, eight times a vector of 64 floats; that is what this method costs.

Edge cases: vectors that are null or hold null or non-finite components are
dropped; equal vec_ids go by their components, null ones come last; with fewer
vectors than ``entries`` the codebooks have as many entries as there are
vectors; an empty table gives an empty result; further columns are ignored.
Vectors of different lengths, lengths that ``parts`` does not divide, and
components whose squared distances leave 62 bits are errors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, keep

_ROWS = 1024
_EXACT = 1 << 53


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c, both int64."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if x.shape[1] * 4 * (int(top) + 1) ** 2 < _EXACT:  # every sum below is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def _below(d2: np.ndarray) -> np.ndarray:
    """A whole number not above the root."""
    return np.floor(np.sqrt(d2.astype(np.float64)) * (1 - 1e-12)).astype(np.int64)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(d2.astype(np.float64)) * (1 + 1e-12)).astype(np.int64)


def elkan_step(x, c, half, move, own, upper, lower):
    """New own, upper and lower for the rows of x (one part position) after the entries moved to ``c``, and how many distances were worked out."""
    at = np.arange(len(x))
    upper = upper + move[own]
    lower = np.maximum(lower - move, 0)
    near = (lower <= upper[:, None]) & (half[own] <= upper[:, None])
    near[at, own] = False
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return own, upper, lower, 0
    # with the exact distance to the own entry most others fall out
    mine = ((x[rows] - c[own[rows]]) ** 2).sum(1)
    upper[rows] = _above(mine)
    lower[rows, own[rows]] = _below(mine)
    near = near[rows] & (lower[rows] <= upper[rows, None]) & (half[own[rows]] <= upper[rows, None])
    i, j = np.nonzero(near)
    done = len(rows) + len(i)
    if len(i) > near.size // 4:
        d2 = squared(x[rows], c)
        lower[rows] = _below(d2)
    else:
        d2 = np.full(near.shape, np.iinfo(np.int64).max)
        d2[i, j] = ((x[rows[i]] - c[j]) ** 2).sum(1)
        lower[rows[i], j] = _below(d2[i, j])
        d2[np.arange(len(rows)), own[rows]] = mine
    own[rows] = d2.argmin(1)  # the first of equal ones
    upper[rows] = _above(d2[np.arange(len(rows)), own[rows]])
    return own, upper, lower, done


@dataclass(frozen=True)
class Codes:
    """rows: vec_id, label, own (array of entries by part) and error; codebooks: parts x entries x components."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "label", x.alias("x")).filter(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))).select("vec_id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _numbers(batch: pa.RecordBatch, name: str, kind: str, *shape: int) -> np.ndarray:
    col = batch.column(name)
    col = col.flatten() if pa.types.is_list(col.type) else col
    if pa.types.is_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(batch), *shape).astype(np.int64)
    return np.asarray(col, dtype=np.int64).reshape(len(batch), *shape)


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    flat = x.reshape(len(x), -1).astype(kind)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _cut(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, _ROWS):
        yield batch.slice(at, _ROWS)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    spark = vectors.sparkSession
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    clean = _whole(vectors, scale)
    size = F.size("v")
    low, high, top = clean.agg(F.min(size), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if low is None:
        return Codes(clean.select("vec_id", "label", F.array().cast("array<int>").alias("own"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64))
    if low != high or low % parts:
        raise ValueError(f"vectors of {low} to {high} components cannot be cut into {parts} equal parts")
    width, top = low // parts, top or 0
    if low * (2 * top + 1) ** 2 >= 1 << 62:
        raise OverflowError(f"squared distances of components up to {top} leave 62 bits")
    first = clean.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # a codebook's size
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    k = books.shape[1]
    reach = 2 * int(np.sqrt(width * (2 * top + 1) ** 2)) + 2  # no bound is above this, as bounds are clipped to it
    kind = "<u2" if reach < 1 << 16 else "<u4" if reach < 1 << 32 else "<u8"
    own_kind = "<u1" if k <= 256 else "<u4"
    label = clean.schema["label"].dataType
    state_type = "own binary, upper binary, lower binary, v binary"
    v_kind = "<i4" if top < 1 << 31 else "<i8"

    def begin(c):
        def run(batches):
            for whole in batches:
                for b in _cut(whole):
                    x = _numbers(b, "v", v_kind, parts, width)
                    own, upper, lower = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts, k), np.int64)
                    for p in range(parts):
                        d2 = squared(x[:, p], c[p])
                        own[:, p] = d2.argmin(1)
                        upper[:, p], lower[:, p] = _above(d2.min(1)), _below(d2)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _bytes(own, own_kind), _bytes(upper, kind), _bytes(lower, kind), _bytes(x, v_kind)], ["vec_id", "label", "own", "upper", "lower", "v"])

        return run

    def again(old, c, last):
        def run(batches):
            half = np.stack([_below(squared(e, e)) // 2 for e in c])
            move = np.stack([_above(((a - b) ** 2).sum(1)) for a, b in zip(c, old, strict=True)])
            for whole in batches:
                for b in _cut(whole):
                    x = _numbers(b, "v", v_kind, parts, width)
                    own, upper, lower = _numbers(b, "own", own_kind, parts), _numbers(b, "upper", kind, parts), _numbers(b, "lower", kind, parts, k)
                    for p in range(parts):
                        own[:, p], upper[:, p], lower[:, p], _ = elkan_step(x[:, p], c[p], half[p], move[p], own[:, p].copy(), upper[:, p], lower[:, p])
                    if last:
                        error = sum(((x[:, p] - c[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
                        listed = pa.ListArray.from_arrays(np.arange(0, own.size + 1, parts, dtype=np.int32), own.ravel().astype(np.int32))
                        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), listed, pa.array(error)], ["vec_id", "label", "own", "error"])
                    else:
                        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _bytes(own, own_kind), _bytes(np.minimum(upper, reach), kind), _bytes(lower, kind), b.column("v")], ["vec_id", "label", "own", "upper", "lower", "v"])

        return run

    def sums(batches):
        """A row for each part and entry that this task has met: n and the sums of its parts."""
        n, s = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for whole in batches:
            for b in _cut(whole):
                x, own = _numbers(b, "v", v_kind, parts, width), _numbers(b, "own", own_kind, parts)
                for p in range(parts):
                    n[p] += np.bincount(own[:, p], minlength=k)
                    np.add.at(s[p], own[:, p], x[:, p])
        p, e = np.nonzero(n)
        listed = pa.ListArray.from_arrays(np.arange(0, len(p) * width + 1, width, dtype=np.int32), s[p, e].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), listed], ["part", "entry", "n", "s"])

    ids = f"vec_id {clean.schema['vec_id'].dataType.simpleString()}, label {label.simpleString()}"
    state = keep(clean.mapInArrow(begin(books), f"{ids}, {state_type}"), "codes")
    for turn in range(rounds):
        met = state.select("own", "v").mapInArrow(sums, "part int, entry int, n bigint, s array<bigint>")
        total = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()  # parts x entries rows
        new = books.copy()
        for r in total:
            new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        last = turn == rounds - 1
        out = state.mapInArrow(again(books, new, last), f"{ids}, own array<int>, error bigint" if last else f"{ids}, {state_type}")
        out = keep(out, "codes")
        drop_kept(spark, state)
        state, books = out, new
    return Codes(state, books)


def with_label_errors(rows: DataFrame, most: int = 100_000, salts: int = 16) -> DataFrame:
    """rows with label_error, the error summed over equal labels, nulls together. Labels beyond ``most`` are joined under salts instead of broadcast."""
    known = F.struct(F.col("label").isNull().alias("none"), "label")
    total = keep(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    mine = rows.withColumn("__k", F.xxhash64(known))
    by = total.select(F.xxhash64(known).alias("__k"), F.col("label").alias("__label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if total.count() <= most:
        return mine.join(F.broadcast(by), ["__k"]).filter(same).drop("__k", "__label")
    by = by.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = mine.withColumn("__s", F.pmod(F.xxhash64("vec_id", "error"), F.lit(salts)).cast("int"))
    return mine.join(by, ["__k", "__s"]).filter(same).drop("__k", "__s", "__label")


def coded(codes: Codes) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    out = with_label_errors(codes.rows)
    code = F.array_join(F.transform("own", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by a full search in every round."""
    text = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, CAST(g AS INTEGER) AS part, v[g * (len(v) // {parts}) + 1 : (g + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) AS r(g)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries})"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}}) AS best FROM p JOIN c{r} USING (part) GROUP BY vec_id, part)"""
        if r < rounds:
            text += f""",
s{r} AS (SELECT part, best.e AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{r} USING (vec_id, part)),
m{r} AS (SELECT part, entry, i, CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM s{r} GROUP BY ALL),
u{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM m{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} USING (part, entry))"""
    return (
        text
        + f""",
f AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) FROM h) AS codebooks_sha256 FROM f JOIN k USING (vec_id)"""
    )


SQL = sql()
