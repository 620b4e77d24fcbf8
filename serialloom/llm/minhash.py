"""MinHash near-dedup of whole texts: bands over word shingles, exact Jaccard, union-find.

Texts are runs of words in lower case; those with the same words are one node.
A text's set holds a hash of every run of ``words`` words (of all its words if
it has fewer). ``bands`` keys of ``rows`` minima each make candidates: at a
similarity of 0.8, two texts share none of 20 keys of 5 with a chance of 0.0004.
Every pair that shares a key is settled by its exact Jaccard similarity, as
lines are (see :func:`serialloom.llm.lines.similar`).

Edge cases: a null text is one without words; texts without words are alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .lines import similar
from .tokens import Words, mix, pieces, rolling

_CHUNK = 1 << 13


def _sets(text: pa.Array, words: int):
    """For each text the hash of its words, and its shingles' distinct hashes."""
    w = Words(text, lower=True)
    h = w.hashes()
    for a, z in zip(w.at[:-1], w.at[1:], strict=True):
        own = h[a:z]
        yield xxhash.xxh64_intdigest(own.tobytes()), np.unique(mix(rolling(own, min(words, len(own))))) if len(own) else own


def keyed(docs: DataFrame, words: int = 5, bands: int = 20, rows: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, th (a hash of the text), h1 (the node) and keys for each row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))

    def run(batches):
        rng = np.random.default_rng(seed)
        by = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)[:, None] | np.uint64(1)
        add, power = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None], rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            for b in pieces(batches):
                nodes, keys = [], []
                for node, s in _sets(b.column("text"), words):
                    nodes.append(node)
                    if not len(s):
                        keys.append(np.zeros(0, np.int64))
                        continue
                    least = np.min([(s[c : c + _CHUNK] * by + add).min(1) for c in range(0, len(s), _CHUNK)], axis=0)
                    keys.append(mix((least.reshape(bands, rows) * power).sum(1, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64))).view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(np.array(nodes, np.uint64).view(np.int64)), listed], ["doc_id", "th", "h1", "keys"])

    return out.mapInArrow(run, "doc_id bigint, th bigint, h1 bigint, keys array<bigint>")


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """h1, n (the size of the set) and x (the set) of each row."""

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            nodes, sets = zip(*_sets(b.column("text"), words), strict=True)
            n = np.array([len(s) for s in sets], np.int32)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(n), listed], ["h1", "n", "x"])

    return docs.select(F.col("text").alias("text")).mapInArrow(run, "h1 bigint, n int, x array<bigint>")


def near_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, most_ids: int = 1_000_000) -> DataFrame:
    """doc_id, th and component for each row: rows of a component reach each other over links of at least this similarity."""
    seen = keep(keyed(docs, words), "keyed")

    def sets(ids: DataFrame) -> DataFrame:
        one = keep(seen.select("h1", "th").join(ids, "h1", "left_semi").groupBy("h1").agg(F.min("th").alias("th")).select("th"), "texts")
        one = F.broadcast(one) if one.count() <= most_ids else one
        texts = docs.select("text", F.xxhash64("text").alias("th")).join(one, "th", "left_semi")
        return shingle_sets(texts, words).dropDuplicates(["h1"])

    same = similar(seen.select("h1", "keys"), sets, lambda x: x, similarity)
    return seen.join(same, F.col("h1") == F.col("node"), "left").select("doc_id", "th", F.coalesce("component", "h1").alias("component"))
