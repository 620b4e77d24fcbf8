"""Filter interaction audit: what each filter removes in every order, and what it would have removed anyway.

Five filters judge a text, by the words ``[^\\x20\\x09-\\x0D]+``: A, under 50
words; B, under 65 % distinct words; C, over 5 % of capitals A to Z; D, any of
``#$%&*|``; E, the same text as a smaller doc_id's anywhere in the table.

A to D need the text alone. For E, texts are routed as an RDD by their xxhash:
each task first merges the copies that it has read, so that a text leaves it
once with its smallest id, whatever the number of copies; behind the shuffle,
equal hashes are chains of entries with their full texts, and of equal texts
the ids that are not the smallest fail E. Ids then go on without their texts.

What a row fails is a mask of five bits. All 120 orders follow from the counts
by mask alone, so ``combineByKey`` merges vectors of 32 masks for each part
(rows, good rows, toxic rows), summed in each task before they are shuffled.

Edge cases: a null text is an empty one (A alone: no words are under 50, but
nothing is over a share of nothing); a null source is the part of the empty
string; a null doc_id is not smaller than any and has none smaller, so that it
neither fails E nor makes others fail; rows that repeat a doc_id each count,
and rows that repeat an id and text are equally small. A label holds for every
row of its doc_id; of repeated labels, one that says good or toxic counts. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_SLICE = 1 << 20
#: Bytes of distinct texts that a task holds before it sends them on.
HELD = 64 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(0x41, 0x5B))
_SIGNS = re.compile(rb"[#$%&*|]")
_E = 16


def words(raw: bytes) -> tuple[int, int]:
    """How many words, and how many different ones; no more than a slice of them is listed at once."""
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = len(raw)
        if at + _SLICE < end and (m := _SPACE.search(raw, at + _SLICE)):
            end = m.start()
        found = raw[at:end].split()
        n += len(found)
        seen.update(found)
        at = end
    return n, len(seen)


def failures(text: str) -> int:
    """The mask of A to D."""
    raw = text.encode()
    n, different = words(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (n < 50) | (100 * different < 65 * n) << 1 | (100 * capitals > 5 * len(text)) << 2 | (_SIGNS.search(raw) is not None) << 3


def _route(rows):
    """(key, entry): for each text of this task one (text, smallest id, mask, rows by part), keyed by its hash; rows that fail E already, and those without an id, as (id, part, mask, n) under keys of their own."""
    chains: dict[int, list[list]] = {}
    held = turn = 0

    def send():
        for fp, chain in chains.items():
            for raw, least, mask, by_part in chain:
                yield fp, (raw, least, mask, tuple(by_part.items()))

    def lost(entry):
        return [(entry[1], part, entry[2] | _E, n) for part, n in entry[3].items()]

    for doc_id, text, part in rows:
        raw = text.encode()
        fp = xxhash.xxh64_intdigest(raw)
        chain = chains.setdefault(fp, [])
        entry = next((e for e in chain if e[0] == raw), None)
        done = []
        if doc_id is None:
            done = [(None, part, entry[2] if entry else failures(text), 1)]
        elif entry is None:
            chain.append([raw, doc_id, failures(text), Counter({part: 1})])
            held += len(raw) + 500
        elif doc_id > entry[1]:
            done = [(doc_id, part, entry[2] | _E, 1)]
        else:
            if doc_id < entry[1]:
                done, entry[1], entry[3] = lost(entry), doc_id, Counter()
            entry[3][part] += 1
        for x in done:
            turn += 1
            yield (turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, x
        if held > HELD:
            yield from send()
            chains.clear()
            held = 0
    yield from send()


def _judge(entries):
    """(id, part, mask, n) from entries sorted by their key: a key's chain is all that is held."""
    for _, same in itertools.groupby(entries, key=lambda kv: kv[0]):
        chain: list[list] = []
        for _, x in same:
            if not isinstance(x[0], bytes):
                yield x
                continue
            raw, least, mask, by_part = x
            entry = next((e for e in chain if e[0] == raw), None)
            if entry is None:
                chain.append([raw, least, mask, Counter(dict(by_part))])
            elif least > entry[1]:
                yield from ((least, part, mask | _E, n) for part, n in by_part)
            elif least == entry[1]:
                entry[3].update(dict(by_part))
            else:
                yield from ((entry[1], part, mask | _E, n) for part, n in entry[3].items())
                entry[1], entry[3] = least, Counter(dict(by_part))
        for _, least, mask, by_part in chain:
            yield from ((least, part, mask, n) for part, n in by_part.items())


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: how many rows of that id and part fail just those filters (bit 0 for A to bit 4 for E)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).rdd
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // HELD))  # a route holds about as much as a task does before
    routed = texts.mapPartitions(_route).repartitionAndSortWithinPartitions(n, lambda key: key % n)
    rows = spark.createDataFrame(routed.mapPartitions(_judge), "doc_id bigint, part string, mask int, n bigint", verifySchema=False)
    return rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def mask_vectors(masks: DataFrame, labels: DataFrame):
    """An RDD of (part, vector): rows, good rows and toxic rows by mask, 3 x 32."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows have been summed by id, so that none, null included, is in the join more often than by part and mask
    met = masks.join(said.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "left")
    small = met.select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vector, x):
        mask, n, good, toxic = x
        vector[:, mask] += (n, n * good, n * toxic)
        return vector

    return small.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda x: add(np.zeros((3, 32), np.int64), x), add, lambda a, b: a + b)


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, the bit of its filter, the bits before it) for all orders."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            found.append(("".join(FILTERS[i] for i in order), step, 1 << f, before))
            before |= 1 << f
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: 600 rows for each part."""
    steps = orders()
    every = len(steps) // len(FILTERS)
    mask = np.arange(32)
    fails = np.array([[bool(m & bit) for m in mask] for _, _, bit, _ in steps])
    earlier = np.array([[bool(m & before) for m in mask] for *_, before in steps])
    alone = np.array([[m == bit for m in mask] for _, _, bit, _ in steps])
    # of the filters that a row fails, each comes first in as many orders
    share = np.array([0, *(every // int(m).bit_count() for m in mask[1:])])

    def rows(found):
        part, vector = found
        n, good, toxic = vector
        counts = {"kept": ~(fails | earlier) @ n, "removed": (fails & ~earlier) @ n, "redundant": (fails & earlier) @ n, "unique": alone @ n, "good": (fails & ~earlier) @ good, "toxic": (fails & ~earlier) @ toxic, "shapley": fails @ (n * share)}
        return [(part, order, step, *(int(x[i]) for x in counts.values())) for i, (order, step, _, _) in enumerate(steps)]

    schema = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return docs.sparkSession.createDataFrame(mask_vectors(failure_masks(docs), labels).flatMap(rows), schema, verifySchema=False)


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, CAST(len(ws) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, FALSE) AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
b(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM b p, b q, b r, b s, b t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
e AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) AS i(k))
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
CAST(coalesce(sum(g) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
CAST(coalesce(sum(n * (120 // nullif(bit_count(mask), 0))) FILTER (WHERE mask & bit <> 0), 0) AS BIGINT) AS shapley FROM m, e GROUP BY part, filter_order, step, bit, before"""
