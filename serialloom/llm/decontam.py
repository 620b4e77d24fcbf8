"""Benchmark decontamination with Spark expressions only: a broadcast set of n-gram hashes meets every window of every text.

The items' distinct n-grams are counted first. The hashes and sizes of up to
``most_grams`` of them (16 bytes each) are broadcast; beyond that, windows and
n-grams are shuffled by hash, which gives the same result. A window is its
place and a 64-bit hash, and carries no words: what meets nothing ends in the
task that read it, and each text sends one row more, with its word count. The
few hits go back to their texts, whose words must equal the n-gram's, so a
collision hits nothing.

Edge cases: a null text has no words and is never hit; an item without words
has no window, one of fewer than ``n`` words is one window; a null
``item_id`` hits words, but is no item to list; rows are told apart by doc_id
and text, so a doc_id may be null or repeat; repeated rows of documents are
returned each, repeated items count once; empty tables give no hits or no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks that the documents' own rows are dealt by.
_MARKS = 1 << 14
#: What words do not hold: ASCII but for digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; an empty array for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), "")


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _window_hash(h: Column, i: Column, k: int) -> Column:
    """The hash of the ``k`` word hashes from place i (from 1) on; single elements, as a slice inside a lambda copies the whole array."""
    return F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(k)])


def item_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """hash, size, gram (array of words) and item_id of each window of each item, once."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.lit(n), F.size("w"))
    gram = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.transform(F.sequence(i, i + size - 1), lambda j: F.get(w, j - 1)))
    each = w.select("item_id", size.alias("size"), F.explode(gram(F.col("w"))).alias("gram"))
    hashes = F.transform("gram", lambda x: F.xxhash64(x))
    own = F.coalesce(*[F.when(F.col("size") == k, _window_hash(hashes, F.lit(1), k)) for k in range(1, n + 1)])
    return each.select(own.alias("hash"), "size", "gram", "item_id").distinct()


def probed(docs: DataFrame, known: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """doc_id, th, n_words, at, size, hash: a row with size 0 for each document, and one for each window whose hash and size are in ``known``."""
    mark = docs.sparkSession.range(_MARKS).select(F.col("id").alias("hash"), F.lit(0).alias("size"))
    probe = mark.unionByName(known).withColumnsRenamed({"hash": "g_hash", "size": "g_size"})
    at = lambda h, k: F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.struct(i.alias("at"), F.lit(k).alias("size"), _window_hash(h, i, k).alias("hash")))
    none = F.array().cast("array<struct<at:int,size:int,hash:bigint>>")
    # size 0 marks the row that each document sends for itself, whose place is its word count; where windows are shuffled by
    # hash, these rows go by one of many, so that documents do not meet in one task
    own = lambda h: F.array(F.struct(F.size(h).alias("at"), F.lit(0).alias("size"), F.pmod(F.xxhash64("doc_id", "th"), F.lit(_MARKS)).alias("hash")))
    hashes = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    each = _let(hashes, lambda h: F.concat(own(h), *[F.when(F.size(h) >= k, at(h, k)).otherwise(none) for k in sizes]))
    # named before the windows are made, or each of them would carry its text
    windows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").select("doc_id", "th", F.inline(each))
    met = windows.join(F.broadcast(probe) if broadcast else probe, (F.col("hash") == F.col("g_hash")) & (F.col("size") == F.col("g_size")))
    return met.select("doc_id", "th", F.when(F.col("size") == 0, F.col("at")).alias("n_words"), "at", "size", "hash")


def verified(docs: DataFrame, hits: DataFrame, grams: DataFrame) -> DataFrame:
    """doc, th, at, size, hash and gram of the hits whose words are those of the n-gram."""
    told = hits.distinct().join(grams, ["hash", "size"]).groupBy(F.col("doc_id").alias("doc"), F.col("th").alias("own")).agg(F.collect_list(F.struct("at", "size", "hash", "gram")).alias("hits"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    both = texts.join(told, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("own"))).dropDuplicates(["doc", "own"])
    right = _let(words(F.col("text")), lambda w: F.filter("hits", lambda h: F.forall(F.sequence(F.lit(0), h["size"] - 1), lambda j: F.get(w, h["at"] - 1 + j) == F.get(h["gram"], j))))
    return both.select("doc", "own", F.inline(right))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_grams: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, spans (from and to, in words from 1, both within), n_hit and items (ids, sorted as strings) for each row."""
    own = docs.select("doc_id", F.col("text").alias("text"))
    of_items = keep(item_grams(benchmark.select("item_id", F.col("text").alias("text")), n), "grams")
    grams = of_items.select("hash", "size", "gram").distinct()
    known = of_items.select("hash", "size").distinct()
    counted = {r["size"]: r["k"] for r in known.groupBy("size").agg(F.count("*").alias("k")).collect()}  # n sizes at most
    seen = keep(probed(own, known, sorted(counted), sum(counted.values()) <= most_grams), "probed")
    found = keep(verified(own, seen.filter("size > 0").select("doc_id", "th", "at", "size", "hash"), grams), "hits")
    by = Window.partitionBy("doc", "own").orderBy("at", "size")
    to = F.col("at") + F.col("size") - 1
    fresh = F.col("at") > F.coalesce(F.max(to).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) + 1
    spots = found.select("doc", "own", "at", "size").distinct()
    spans = spots.select("doc", "own", "at", to.alias("to"), fresh.cast("int").alias("new")).withColumn("span", F.sum("new").over(by.orderBy("at", "to").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "own", "span").agg(F.min("at").alias("from"), F.max("to").alias("to")).groupBy("doc", "own").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"), F.sum(F.col("to") - F.col("from") + 1).alias("n_hit"))
    items = found.select("doc", "own", "hash", "size", "gram").distinct().join(of_items.filter("item_id IS NOT NULL"), ["hash", "size", "gram"])
    items = items.groupBy(F.col("doc").alias("i_doc"), F.col("own").alias("i_own")).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    here = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("own"))
    listed = F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("th") == F.col("i_own"))
    out = seen.filter("size = 0").join(spans, here, "left").join(items, listed, "left")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """hit_id: the doc_id of each row that a window of an item occurs in, once."""
    return decontaminate(docs, benchmark, n).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id")).distinct()


def remove_spans(words_of: Column, spans: Column) -> Column:
    """The words outside of these spans."""
    gone = F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"])))
    return _let(words_of, lambda w: F.transform(F.array_except(F.sequence(F.lit(1), F.size(w)), gone), lambda i: F.get(w, i - 1)))


SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), grams AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT k FROM grams
), hits AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM words, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
), met AS (
    SELECT doc_id, i, hits.k, item_id FROM hits JOIN grams ON hits.k = grams.k AND hits.g = grams.g
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id
), told AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN told USING (doc_id)
"""
