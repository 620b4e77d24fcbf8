"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

A fingerprint is cut into ``blocks`` blocks. Two that differ in at most
``distance`` bits agree in ``blocks - distance`` blocks at least, so each set
of that many blocks is a key, and only fingerprints with an equal key meet.
Distinct fingerprints meet once, whatever the number of texts that have them.
Keys that more than ``hot`` fingerprints share are split: their members must
still agree in one of the pieces of their other bits, so these pieces join the
key, up to ``levels`` times (each multiplies a fingerprint's rows by the number
of pieces). Every group of a key is verified in full, in strips, so that it
needs eight bytes a fingerprint beside a strip's; only a spanning forest of its
links leaves it.

Edge cases: a null or empty text has fingerprint 0 and is linked like any
other; a null ``doc_id`` has a fingerprint and takes the component of the
others that reach it (null if none); repeated rows are returned each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .components import connected_components
from .tokens import Words, pieces

_CHUNK = 1 << 16


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (bigint): a bit is 1 if it is set in over half of the XXH64 of all shingles, repeats included."""
    rows = docs.select("doc_id", F.col("text").alias("text"))

    def run(batches):
        for b in pieces(batches):
            w = Words(b.column("text"), lower=True)
            fps = np.zeros(b.num_rows, np.uint64)
            digest = xxhash.xxh64_intdigest
            for i in range(b.num_rows):
                a, z = w.at[i], w.at[i + 1]
                if a == z:
                    continue
                lens = w.lens[a:z]
                line = b" ".join(w.buf[w.starts[a] : w.starts[z - 1] + lens[-1]].tobytes().split())
                begin = np.concatenate([[0], np.cumsum(lens + 1)])
                k = min(words, z - a)
                starts, ends = begin[: len(begin) - k], begin[k:] - 1
                ones, n = np.zeros(64, np.int64), len(starts)
                for c in range(0, n, _CHUNK):
                    h = np.array([digest(line[s:e], seed) for s, e in zip(starts[c : c + _CHUNK].tolist(), ends[c : c + _CHUNK].tolist(), strict=True)], dtype="<u8")
                    ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fps[i] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _cuts(bits: list[int], n: int) -> list[list[int]]:
    return [[int(b) for b in x] for x in np.array_split(np.array(bits), n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _keyed(fp: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for m in masks])


def block_keys(fps: DataFrame, distance: int, blocks: int, hot: int, levels: int = 2) -> DataFrame:
    """mask, key, fp, node: a row for each key by which a fingerprint may meet another; keys of a single one are left out."""
    parts = _cuts(list(range(64)), blocks)
    masks = [_mask(sum(c, [])) for c in combinations(parts, blocks - distance)]
    now = fps.select("fp", "node", F.explode(_keyed(F.col("fp"), masks)).alias("k")).select("k.mask", "k.key", "fp", "node")
    done, level = [], {m: [b for b in range(64) if not m >> b & 1] for m in masks}
    for depth in range(levels + 1):
        counts = keep(now.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
        many = counts.filter(F.col("n") > hot).select("mask").distinct().collect()  # as many as there are masks, at most
        many = many if depth < levels else []
        some = counts.filter(F.col("n") <= hot) if many else counts
        done.append(now.join(some.select("mask", "key"), ["mask", "key"]))
        if not many:
            break
        # a pair that agrees on a mask and differs in few of the other bits agrees on one of distance + 1 pieces of these
        finer = {}
        for r in many:
            rest = level[r["mask"]]
            for piece in _cuts(rest, min(distance + 1, len(rest))) if rest else []:
                finer.setdefault(r["mask"], []).append(r["mask"] | _mask(piece))
        if not finer:
            break
        large = now.join(counts.filter(F.col("n") > hot).select("mask", "key"), ["mask", "key"])
        choice = F.coalesce(*[F.when(F.col("mask") == m, _keyed(F.col("fp"), x)) for m, x in finer.items()])
        now = keep(large.select("fp", "node", F.explode(choice).alias("k")).select("k.mask", "k.key", "fp", "node").distinct(), "finer")
        level = {m: [b for b in range(64) if not m >> b & 1] for x in finer.values() for m in x}
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _forest(x: np.ndarray, distance: int, rows: int = 512) -> np.ndarray:
    """For each entry of x the least index that it reaches over links of at most ``distance`` bits."""
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for a in range(0, len(x), rows):
            near = np.bitwise_count(x[a : a + rows, None] ^ x[None, :]) <= distance
            new[a : a + rows] = np.where(near, label[None, :], len(x)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def links(keyed: DataFrame, distance: int) -> DataFrame:
    """a and b (nodes): a spanning forest of the links in each key's group."""
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held = None
        for b in batches:
            mask, key, fp, node = (np.asarray(b.column(c)) for c in ("mask", "key", "fp", "node"))
            now = [mask, key, fp.view(np.uint64), node]
            if held is not None:
                now = [np.concatenate([u, v]) for u, v in zip(held, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [v[cut:] for v in now]
            if cut:
                yield from groups([v[:cut] for v in now])
        if held is not None:
            yield from groups(held)

    def groups(v):
        mask, key, fp, node = v
        head = np.ones(len(key), bool)
        head[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(key)))
        two = first[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [node[two]], [node[two + 1]]
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            label = _forest(fp[f : f + n], distance)
            tied = np.flatnonzero(label != np.arange(n))
            a.append(node[f + tied])
            b.append(node[f + label[tied]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = keyed.repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = 5, seed: int = 42, hot: int = 8192) -> DataFrame:
    """doc_id, fp (bigint) and component_id, the smallest doc_id that the row's fingerprint reaches, for each row."""
    seen = keep(fingerprints(docs, words, seed), "fps")
    # a fingerprint is its own node, so that those of rows without an id link as well
    nodes = keep(seen.select("fp", F.col("fp").alias("node")).distinct(), "nodes")
    found = connected_components(links(block_keys(nodes, distance, blocks, hot), distance))
    first = seen.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = keep(first.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return seen.join(named.join(least, "component").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")
