"""Substring dedup: every window of ``width`` words is hashed by Rabin-Karp and counted; repeats merge into removal intervals.

A window is removed if the same words start earlier, in a smaller doc_id or
earlier in the same document. Windows go to blocks by their hash, packed, and
once for each piece of text at most: what repeats within a piece is settled
there, so that a passage that a third of all texts hold is no larger in its
block than a rare one. A block returns the places that lost; these are packed
by document and joined to the texts, and overlapping windows merge into
maximal intervals.

A window is known by its 64-bit hash and by a second one's bits that choose
its block; over 10**10 windows, two different ones are taken for equal with
a chance of less than one in 10**3.

Edge cases: a null text has no words; texts shorter than a window stay as they
are; rows with a null ``doc_id`` come before all others, by a hash of their texts;
rows that repeat a ``doc_id`` with another text are documents of their own, in
the order of a hash of their texts, those that repeat both are one, returned
for each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .tokens import Words, mix, pack, pieces, rolling, unpack

#: Rows without an id are documents below all others, told apart by their text.
NO_ID = -(1 << 63)
#: Bytes of text for each block of windows.
_BLOCK_BYTES = 6 << 20
_SCHEMA = "block int, doc bigint, keys binary, docs binary, at binary"


def doc_key(docs: DataFrame):
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, doc (a number for each document, in their order) and text; and the bytes of all texts."""
    th = F.xxhash64("text")
    by = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(th) != F.max(th)).alias("several"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if by.filter("several").isEmpty():
        return docs.select("doc_id", doc_key(docs).alias("doc"), "text"), size
    # a sorted table's row numbers rise with its order
    known = keep(docs.select(F.col("doc_id").alias("id"), th.alias("th")).distinct().orderBy(F.asc_nulls_first("id"), "th").select("id", "th", F.monotonically_increasing_id().alias("doc")), "numbers")
    return docs.join(known, F.col("doc_id").eqNullSafe(F.col("id")) & (th == F.col("th"))).select("doc_id", "doc", "text"), size


def _batch(block, doc, keys, docs, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(doc, pa.int64()), pa.array(keys, pa.binary()), pa.array(docs, pa.binary()), pa.array(at, pa.binary())], ["block", "doc", "keys", "docs", "at"])


def _by_doc(docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Places by document; ``docs`` is sorted."""
    ids, first = np.unique(docs, return_index=True)
    cuts = np.append(first, len(docs))
    return ids, [pack(np.sort(at[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _firsts(keys: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries are the first of their key, by document and place. Entries come in any order."""
    order = np.lexsort((at, docs, keys))
    k, d, a = keys[order], docs[order], at[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    same = np.zeros(len(k), bool)  # the same place again, from a repeated row
    same[1:] = ~head[1:] & (d[1:] == d[:-1]) & (a[1:] == a[:-1])
    run = np.cumsum(head) - 1
    lead = np.flatnonzero(head)[run] if len(k) else run
    first = head | ((d == d[lead]) & (a == a[lead]))
    out = np.empty(len(k), bool)
    out[order] = first
    return out


def removals(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """doc (see :func:`numbered`) and ``at``, the packed starts of windows that repeat an earlier one; many rows for a document."""
    rows = docs.select("doc", "text")

    def send(batches):
        for b in pieces(batches):
            doc = np.asarray(b.column("doc"))
            order = np.argsort(doc, kind="stable")
            w = Words(b.column("text").take(pa.array(order)))
            doc = doc[order]
            n = np.diff(w.at)
            at = np.arange(len(w)) - np.repeat(w.at[:-1], n)
            whole = at + width <= np.repeat(n, n)
            own = np.repeat(doc, n)[whole]
            at = at[whole]
            if not len(at):
                continue
            spot = np.flatnonzero(whole)
            h = w.hashes()
            keys = rolling(h, width)[spot]
            block = (rolling(mix(h), width)[spot] >> np.uint64(40)) % np.uint64(blocks)
            del h, whole
            # a stable sort leaves equal keys in order of document and place
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            again = np.zeros(len(k), bool)
            again[1:] = k[1:] == k[:-1]
            later = np.zeros(len(k), bool)
            later[order] = again
            if again.any() and len(np.unique(doc)) < len(doc):
                later = ~_firsts(keys, own, at)
            if later.any():
                ids, packed = _by_doc(own[later], at[later])
                none = [None] * len(ids)
                yield _batch(blocks + (mix(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32), ids, none, none, packed)
            keys, own, at, block = keys[~later], own[~later], at[~later], block[~later].astype(np.int32)
            order = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")
            keys, own, at, block = keys[order], own[order], at[order], block[order]
            found, first = np.unique(block, return_index=True)
            cuts = np.append(first, len(block))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield _batch(
                found,
                [int(own[a]) for a, _ in spans],
                [keys[a:b].tobytes() for a, b in spans],
                [pack(np.diff(own[a:b], prepend=own[a]).view(np.uint64)) for a, b in spans],
                [pack(at[a:b]) for a, b in spans],
            )

    def settle(t: pa.Table) -> pa.Table:
        if t.column("block")[0].as_py() >= blocks:
            return t.select(["doc", "at"])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()])
        own = np.concatenate([d + np.cumsum(unpack(x).astype(np.uint64).view(np.int64)) for d, x in zip(t.column("doc").to_pylist(), t.column("docs").to_pylist(), strict=True)])
        at = np.concatenate([unpack(x).astype(np.int64) for x in t.column("at").to_pylist()])
        order = np.argsort(keys)
        k = keys[order]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        some = order[twin]
        lost = some[~_firsts(keys[some], own[some], at[some])]
        lost = lost[np.argsort(own[lost], kind="stable")]
        ids, packed = _by_doc(own[lost], at[lost])
        return pa.table({"doc": pa.array(ids, pa.int64()), "at": pa.array(packed, pa.binary())})

    return rows.mapInArrow(send, _SCHEMA).groupBy("block").applyInArrow(settle, "doc bigint, at binary")


def intervals(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal intervals (from, to) that windows of ``width`` at these sorted places cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > width)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + width


def dedup_substrings(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of [from, to) in words) and kept, the words that stay joined by a space."""
    own, size = numbered(docs.select("doc_id", F.col("text").alias("text")))
    blocks = max(64, -(-size // _BLOCK_BYTES))
    lost = keep(removals(own, width, blocks), "removals")
    lost = lost.groupBy("doc").agg(F.collect_list("at").alias("at"))

    def cut(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            n = np.diff(w.at)
            removed, spans, kept = [], [], []
            for i, at in enumerate(b.column("at").to_pylist()):
                gone = np.zeros(n[i] + 1, np.int32)
                starts = np.unique(np.concatenate([np.zeros(0, np.int64), *(unpack(y).astype(np.int64) for y in at)]))
                a, z = intervals(starts[starts + width <= n[i]], width)
                gone[a] += 1
                gone[z] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                removed.append(int(n[i] - stay.sum()))
                spans.append(list(zip(a.tolist(), z.tolist(), strict=True)))
                kept.append(w.text_of(i, stay))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array([[{"from": f, "to": t} for f, t in s] for s in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    whole = own.join(lost, "doc", "left").select("doc_id", "text", F.coalesce("at", F.array().cast("array<binary>")).alias("at"))
    return whole.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<from:bigint,to:bigint>>, kept string")


SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)
), first AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows
), gone AS (
    SELECT doc_id, i FROM first WHERE k > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM gone
), flags AS (
    SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM covered GROUP BY doc_id
), breaks AS (
    SELECT doc_id, count(*) AS n_intervals FROM (
        SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone
    ) WHERE before IS NULL OR i > before + 20 GROUP BY doc_id
), long AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
    SELECT l.doc_id, string_agg(l.word, ' ' ORDER BY l.p) AS kept
    FROM long l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.p = c.p GROUP BY l.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_intervals, 0) AS BIGINT) AS n_intervals
FROM words LEFT JOIN flags USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN breaks USING (doc_id)
"""
