"""Document fingerprints: a threshold-scaled sketch of word shingles.

A text's words (A to Z lower-cased) give a hash for every run of five; a text
of fewer words gives one of all of them. The sketch keeps each hash below a
fixed fraction of the range, so that its size follows the text's, the union of
two sketches is the sketch of both texts, and the share of a short text that a
very long one holds can be told from the two sketches alone.

A fingerprint is text: 16 hexadecimal digits (a hash of all words) and, behind a
colon, the kept hashes in order, 32 bits each, in base 64. The head tells equal
texts apart from others where the sketch is empty, as it may be for a short text.

Likeness is the Jaccard similarity of two sketches; it is 1 for equal word
sequences, and 0 where either sketch is empty and the words differ.

:func:`edited_fingerprints` compares each text to an edited one that borrows
from the next document by id. The order is dealt to buckets by quantiles of the
ids (ids that fill several are split further by the hash of their texts); each
bucket also gets the first document of the following one, so that texts are
shuffled once and no bucket waits for another.

Edge cases: a null text is an empty one; null ids come last, in the order of
their texts' hashes, as equal ids do; rows that repeat an id and text are one
document with a row each; a single document is its own next; an empty table
gives an empty result; further columns are ignored. Texts of any length are read
in slices.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Words, mix, rolling

WORDS = 5
#: Of the hashes of 64 bits, those below 2**(64 - SHIFT) are kept: a quarter.
SHIFT = 2
_KEEP = np.uint64(1 << (64 - SHIFT))
#: Code points of text that are worked on at once.
_BATCH = 4 << 20
_SPACE = " \t\n\x0b\x0c\r"
_SUBS = 64


def _shown(digest: int, kept: np.ndarray) -> str:
    short = np.unique((kept >> np.uint64(32 - SHIFT)).astype("<u4"))
    return f"{digest:016x}:{base64.b64encode(short.tobytes()).decode()}"


def _low(h: np.ndarray, words: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(rolling(h, words))
    return x[x < _KEEP]


def _long(text: str, words: int) -> str:
    """The fingerprint of a text that is read in slices, each of which ends behind a word."""
    digest, kept, tail, n, at = xxhash.xxh64(), [], np.zeros(0, np.uint64), 0, 0
    while at < len(text):
        end = min(at + _BATCH, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        h = Words(pa.array([text[at:end]], pa.large_string()), lower=True).hashes()
        digest.update(h.tobytes())
        n, at = n + len(h), end
        joined = np.concatenate([tail, h])
        kept.append(np.unique(_low(joined, words)))
        tail = joined[max(0, len(joined) - words + 1) :]
    if 0 < n < words:
        kept = [_low(tail, n)]
    return _shown(digest.intdigest(), np.concatenate(kept or [tail]))


def fingerprints(texts: list[str], words: int = WORDS) -> list[str]:
    """The fingerprint of each text; short ones are read together."""
    out: list[str] = [""] * len(texts)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BATCH):
            size += len(texts[end])
            end += 1
        if size > _BATCH:
            out[at] = _long(texts[at], words)
        else:
            w = Words(pa.array(texts[at:end], pa.large_string()), lower=True)
            h = w.hashes()
            with np.errstate(over="ignore"):
                every = mix(rolling(h, words))
            for i, (a, z) in enumerate(zip(w.at[:-1], w.at[1:], strict=True)):
                low = every[a : z - words + 1] if z - a >= words else mix(rolling(h[a:z], z - a)) if z > a else h[:0]
                out[at + i] = _shown(xxhash.xxh64_intdigest(h[a:z].tobytes()), low[low < _KEEP])
        at = end
    return out


def hashes_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), "<u4")


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts taken together; its head says no more than which two."""
    if a == b:
        return a
    kept = np.union1d(hashes_of(a), hashes_of(b)).astype("<u4")
    head = int(a[:16], 16) ^ int(b[:16], 16)
    return f"{head:016x}:{base64.b64encode(kept.tobytes()).decode()}"


def _common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def alike(a: str, b: str) -> float:
    if a[:16] == b[:16]:
        return 1.0
    x, y = hashes_of(a), hashes_of(b)
    both = _common(x, y)
    return both / (len(x) + len(y) - both) if both else 0.0


def held(a: str, b: str) -> float:
    """The share of a's shingles that b has too."""
    if a[:16] == b[:16]:
        return 1.0
    x = hashes_of(a)
    return _common(x, hashes_of(b)) / len(x) if len(x) else 0.0


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with the fingerprint of each text in a further column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(["" if t is None else t for t in texts], words), dtype=object)

    return docs.withColumn(name, run(F.col(text)))


def _pairwise(f) -> Callable[[Column, Column], Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return lambda a, b: F.pandas_udf(run, "double")(a, b)


#: The Jaccard similarity of two columns of fingerprints, and the share of the first that the second holds; null for a null.
likeness, containment = _pairwise(alike), _pairwise(held)


def edit(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the start of another text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _buckets(ids: np.ndarray, none: np.ndarray, th: np.ndarray, cuts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Buckets that follow the order: ids downwards, then hashes upwards where an id fills several buckets, null ids last."""
    at = len(cuts) - np.searchsorted(cuts, ids, side="right")
    split = np.isin(ids, hot) | none
    sub = ((th.astype(np.int64) >> 58) + _SUBS // 2) * split
    return np.where(none, len(cuts) + 1, at) * _SUBS + sub


def _columns(b: pa.RecordBatch):
    col = b.column("doc_id")
    none = np.asarray(col.is_null())
    return np.asarray(col.fill_null(0), dtype=np.int64), none, np.asarray(b.column("th"), dtype=np.int64)


def _deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """place, bucket, border, doc_id, th, text and copies, and how many places there are. The border row of a bucket is the one that follows its last."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id", "text").rdd.getNumPartitions())  # with the input
    marks = [i / (2 * n) for i in range(1, 2 * n)]
    found = own.agg(F.percentile_approx("doc_id", marks, max(10_000, 20 * n))).first()[0] or []
    at = np.array(found, np.int64)
    hot = np.unique(at[1:][at[1:] == at[:-1]])  # ids that fill more than a bucket have buckets of their own
    cuts = np.unique(np.concatenate([at, hot[hot < np.iinfo(np.int64).max] + 1]))

    def number(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, none, th = _columns(b)
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(ids, none, th, cuts, hot)), b.column("doc_id"), b.column("th")], ["bucket", "doc_id", "th"])

    numbered = own.select("doc_id", "th").mapInArrow(number, "bucket bigint, doc_id bigint, th bigint")
    heads = numbered.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "th")).alias("h")).orderBy("bucket").collect()  # a row for each bucket
    # the first document of a bucket also goes to the bucket before it, that of the first one to the last
    to = {(None if r["h"]["down"] is None else ~r["h"]["down"], r["h"]["th"]): heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    # neighbouring buckets share a place, each place has as many
    held = np.array([r["bucket"] for r in heads], np.int64)
    first_hashes = np.array([k[1] for k in to], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, none, th = _columns(b)
            bucket = _buckets(ids, none, th, cuts, hot)
            # copies of a row that meet here leave as one
            seen: dict[tuple, int] = {}
            copies = np.ones(len(ids), np.int64)
            stay = np.ones(len(ids), bool)
            _, inverse, counts = np.unique(th, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(counts[inverse] > 1).tolist():
                key = (None if none[i] else int(ids[i]), b.column("text")[i].as_py())
                if (j := seen.setdefault(key, i)) != i:
                    copies[j] += 1
                    stay[i] = False
            hit = [(i, to[key]) for i in np.flatnonzero(np.isin(th, first_hashes) & stay).tolist() if (key := (None if none[i] else int(ids[i]), int(th[i]))) in to]
            rows = np.concatenate([np.flatnonzero(stay), np.array([i for i, _ in hit], np.int64)])
            buckets = np.concatenate([bucket[stay], np.array([p for _, p in hit], np.int64)])
            border = np.concatenate([np.zeros(stay.sum(), bool), np.ones(len(hit), bool)])
            pick = pa.array(rows)
            at = (np.searchsorted(held, buckets) * n // max(1, len(held))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(buckets), pa.array(border), b.column("doc_id").take(pick), b.column("th").take(pick), b.column("text").take(pick), pa.array(copies[rows])], ["place", "bucket", "border", "doc_id", "th", "text", "copies"])

    dealt = own.select("doc_id", "th", "text").mapInArrow(deal, "place int, bucket bigint, border boolean, doc_id bigint, th bigint, text string, copies bigint")
    return dealt, n


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_edited double"


def edited_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and held_by_edited of each row."""
    dealt, n = _deal(docs)
    ordered = dealt.repartitionById(n, F.col("place")).sortWithinPartitions("bucket", "border", F.desc_nulls_last("doc_id"), "th", "text")
    lacking = "bucket {} lacks the row that follows it; the input has changed meanwhile"
    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("held_by_edited", pa.float64())])

    def follow(batches: Iterator[pa.RecordBatch]):
        """(doc_id, text, copies, the next text) of every document."""
        last = None
        for b in batches:
            texts = b.column("text")
            for i, (bucket, border, doc_id, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("bucket", "border", "doc_id", "copies")), strict=True)):
                text = texts[i].as_py()
                if last is not None:
                    if last[0] != bucket:
                        raise RuntimeError(lacking.format(last[0]))
                    if not border and last[1:3] == [doc_id, text]:
                        last[3] += copies
                        continue
                    yield *last[1:], text
                # a border row may come several times; the first one ends its bucket
                last = None if border else [bucket, doc_id, text, copies]
        if last is not None:
            raise RuntimeError(lacking.format(last[0]))

    def rows(found: list[tuple]) -> Iterator[tuple]:
        changed = fingerprints([edit(text, nxt) for _, text, _, nxt in found], words)
        texts = list(dict.fromkeys(t for _, text, _, nxt in found for t in (text, nxt)))
        prints = dict(zip(texts, fingerprints(texts, words), strict=True))
        for (doc_id, text, copies, nxt), e in zip(found, changed, strict=True):
            f = prints[text]
            one = doc_id, len(text), hashlib.sha256(edit(text, nxt).encode()).hexdigest(), f, e, alike(f, e), alike(f, prints[nxt]), held(f, e)
            yield from itertools.repeat(one, copies)

    def run(batches: Iterator[pa.RecordBatch]):
        for found in _runs(follow(batches), lambda f: len(f[1]), _BATCH):
            for some in itertools.batched(rows(found), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)

    return ordered.mapInArrow(run, RESULT)


def _runs(items, size_of, most_size: int, most: int = 2000):
    """Lists of items, each ended by its size or its number."""
    now, size = [], 0
    for x in items:
        now.append(x)
        size += size_of(x)
        if size >= most_size or len(now) >= most:
            yield now
            now, size = [], 0
    if now:
        yield now
