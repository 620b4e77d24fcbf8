"""Mixing sources to target weights, with Spark expressions only.

Each source's documents, in a pseudorandom order, are one stream of words cut
into blocks of ``block`` words. A source's target says how many blocks the mix
takes of it; these slots are drawn to output shards independently and evenly,
so that a source's counts over the shards are multinomial. The slots of a
source pass through a pseudorandom permutation of its block indices (another
one for each pass over the source), and blocks are joined by index.

Targets: sources in code point order, null last, get the weights in turn and
share the size of everything; none gets more than ``most`` times its own size,
and the excess is shared anew by weight. As whole passes are taken first, no
block and so no document is used more than ``most`` times.

Edge cases: a null text has no words; documents without words take nothing; a
null source is a source; a source whose size is 0 has target 0; repeated rows
are documents of their own; an empty table gives an empty result; further
columns are ignored. What goes through the driver is one row per source. A
source's offsets are summed in two steps (within buckets of about
``bucket_rows`` documents, then over buckets), so that a hot source is dealt
over as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the swap-or-not shuffle that permutes block indices.
ROUNDS = 12
_SLOT_RUN = 4096


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), most: float = 3) -> list[tuple[str | None, int, float]]:
    """(source, size, target words) in code point order, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [float(weights[i % len(weights)]) for i in range(len(order))]
    total, full = float(sum(s for _, s in order)), set()
    while True:
        rest = total - sum(most * order[i][1] for i in full)
        scale = sum(w for i, w in enumerate(weight) if i not in full)
        share = [most * order[i][1] if i in full else rest * w / scale for i, w in enumerate(weight)]
        over = {i for i, (_, s) in enumerate(order) if i not in full and share[i] > most * s}
        if not over:
            return [(name, s, float(t)) for (name, s), t in zip(order, share, strict=True)]
        full |= over


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """x's place under a pseudorandom permutation of 0 to n - 1: the swap-or-not shuffle, keyed by ``key``."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, F.lit("key"), *key), n) - x, n)
        take = F.xxhash64(r, F.lit("bit"), *key, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(take, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, swap)


def slots(spark: SparkSession, plan: Sequence[tuple[int, int, int]], shard_slots: int, seed: int) -> DataFrame:
    """src, slot, shard and block of every slot. plan: (src, blocks, slots)."""
    total = sum(n for _, _, n in plan)
    shards = max(1, -(-total // shard_slots))
    runs = spark.createDataFrame([p for p in plan if p[2]], "src int, blocks bigint, slots bigint").select("*", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("slots") - 1) / _SLOT_RUN).cast("long"))).alias("run"))
    first = F.col("run") * _SLOT_RUN
    one = runs.repartition(max(1, min(10_000, total // 200_000 + 1)), "src", "run").select("src", "blocks", F.explode(F.sequence(first, F.least(first + _SLOT_RUN, F.col("slots")) - 1)).alias("slot"))
    turn = (F.col("slot") / F.col("blocks")).cast("long")
    return one.select(
        "src",
        "slot",
        F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "src", "slot"), F.lit(shards)).alias("shard"),
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("src"), turn).alias("block"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, block: int = 64, shard_slots: int = 16_384, seed: int = 17, bucket_rows: int = 4_000) -> dict[str, DataFrame]:
    """``documents``: doc_id, size, source_size, target, taken, source; ``slots``: src, slot, shard, block;
    ``pieces``: src, block, row, place, from_word and n (the words that a document has in a block); ``sources``; ``rows``: row, doc_id, th."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = keep(docs.select("doc_id", F.col("source").alias("source"), size.alias("size"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row")), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    docs_of = {r["source"]: r["docs"] for r in found}
    told = targets([(r["source"], r["size"]) for r in found], weights, most)
    rows, plan = [], []
    for src, (name, words, target) in enumerate(told):
        blocks = -(-words // block)
        passes = min(int(target // words), int(most)) if words else 0
        rest = round((target - passes * words) / words * blocks) if words else 0
        rows.append((src, name, words, target, max(1, -(-docs_of[name] // bucket_rows))))
        plan.append((src, blocks, passes * blocks + rest))
    sources = spark.createDataFrame(rows, "src int, name string, source_size bigint, target double, buckets int")
    # one row per source, as many as the mixture names
    own = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["name"])).drop("name")
    own = own.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), F.col("buckets")).cast("int"))
    filled = own.filter(F.col("size") > 0)
    by_bucket = filled.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_bucket.select("src", "bucket", before.alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("src", "bucket").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "th"), "doc_id", "th", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = filled.select("src", "bucket", "row", "size", inside.alias("inside")).join(base, ["src", "bucket"]).select("src", "row", "size", (F.col("base") + F.col("inside")).alias("at"))
    first, last = (F.col("at") / block).cast("long"), ((F.col("at") + F.col("size") - 1) / block).cast("long")
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block, F.col("at"))
    pieces = pieces.select("src", "block", "row", F.col("at").alias("place"), (begin - F.col("at")).alias("from_word"), (F.least(F.col("block") * block + block, F.col("at") + F.col("size")) - begin).alias("n"))
    drawn = slots(spark, plan, shard_slots, seed)
    used = drawn.groupBy("src", "block").agg(F.count("*").alias("times"))
    # slots are made up from one row per source, so their size can't be estimated: without the hint they would be broadcast
    taken = pieces.join(used.hint("merge"), ["src", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = own.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    return {"documents": out, "slots": drawn, "pieces": pieces, "sources": sources, "rows": sized.select("row", "doc_id", "th")}


def mixed_blocks(docs: DataFrame, mix: dict[str, DataFrame]) -> DataFrame:
    """shard, slot, src and text of every block that the mix takes: its words, joined by a space. mix: what :func:`mix_sources` gave for ``docs``."""
    th = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").alias("id"), th.alias("own"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("w")).dropDuplicates(["id", "own"])
    pieces = mix["pieces"].join(mix["rows"], "row")
    cut = pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("own"))).select("src", "block", "place", F.array_join(F.slice("w", (F.col("from_word") + 1).cast("int"), F.col("n").cast("int")), " ").alias("part"))
    # a block has no more parts than words
    blocks = cut.groupBy("src", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "part")))["part"], " ").alias("text"))
    return mix["slots"].join(blocks.hint("merge"), ["src", "block"]).select("shard", "slot", "src", "text")
