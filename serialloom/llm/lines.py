"""Fuzzy line dedup with Spark expressions only: MinHash bands, exact Jaccard, distributed union-find.

Lines are the parts of a text between line feeds, compared trimmed and in
lower case; blank lines always stay. Equal lines are found by a 128-bit hash.
The set that stands for a line holds the hashes of its character shingles, the
``chars`` characters from each position on; a shorter line is one shingle. The
range of hashes is cut into ``bins`` equal bins; a band is the ``rows`` least
hashes of a bin, and lines with an equal band are candidates. The bands of a line of
many words are of those shingles only that start a word, which one regular
expression cuts out; bands choose what is compared, no more. Candidates are verified by
the exact Jaccard similarity of their sets, links of at least ``similarity``
go through the union-find, and of each component the line that comes first (by
doc_id, then place) is kept.

The pairs of a group of up to ``whole`` lines are all verified. The lines of a
larger group are first paired with a few anchors (its least and greatest line
and those of two other orders), which are aggregates, and components are
found. Lines of groups that then still hold several components are joined
without loss: each by its rarest shingles, of which two similar lines share
one, with bounds by size and position, and only across components.

Edge cases: a null text stays null and has no lines; a null ``doc_id`` comes
first; rows that repeat both doc_id and text are one document, returned each;
a text whose lines all go is an empty one; an empty table gives an empty
result; further columns are passed through, but for those named n_lines or
n_removed, whose place the counts take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_kept, keep
from .components import connected_components

#: Rows of 8 to 24 bytes up to which a counted table is broadcast; beyond that, both sides are shuffled.
MOST_ROWS = 1_000_000
_SALTS = 16
#: Buckets of shingles whose counts are broadcast, 16 bytes each.
_BUCKETS = 1 << 20
#: Starts of words from which on a line's keys are of these only, the bins of their hashes, and how many of a bin make a key.
_FEW = 30
_STARTS_BINS, _STARTS_ROWS = 9, 3


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once: inside lambdas, Spark would work it out again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def shingles(line: Column, chars: int = 9) -> Column:
    """The hashes of a line's shingles in order of position, repeats included. Four bytes a character, so that each is cut out at once."""
    wide = 4 * chars
    at = lambda b: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b) - wide + 1), F.lit(4))
    return _let(F.encode(line, "UTF-32"), lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(wide)))))


def with_bands(rows: DataFrame, hashes: Column, bins: int, rows_of: int, least: int = 1) -> DataFrame:
    """``rows`` and ``keys``: one key for each bin of ``least`` values or more, the hash of its ``rows_of`` least values.

    The bins' lower ends are sorted in among the hashes, so that a bin is what
    stands between two of them. Where hashes repeat much, repeats go first.
    """
    ends = [-(1 << 63) + b * (1 << 64) // bins for b in range(bins)] + [(1 << 63) - 1]
    marked = rows.withColumn("__s", F.sort_array(F.concat(F.array(*[F.lit(x) for x in ends]), hashes)))
    head = F.slice("__s", 1, 32)
    marked = marked.withColumn("__s", F.when(F.size(F.array_distinct(head)) < 0.9 * F.size(head), F.sort_array(F.array_distinct("__s"))).otherwise(F.col("__s")))
    placed = marked.select("*", *[F.array_position("__s", F.lit(x)).cast("int").alias(f"__p{b}") for b, x in enumerate(ends)])
    key = lambda b, n: F.when(n >= least, F.xxhash64(F.lit(b), F.slice("__s", F.col(f"__p{b}") + 1, F.least(n, F.lit(rows_of)))))
    # beyond 8,000 bytes of code a step (some 12 bins), the JVM does not compile it
    keys = F.array(*[key(b, F.col(f"__p{b + 1}") - F.col(f"__p{b}") - 1) for b in range(bins)])
    return placed.select(*rows.columns, keys.alias("keys"))


def starts(line: Column, chars: int = 9) -> Column:
    """The hashes of those of a line's shingles that start a word, each once."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), line), F.lit(rf"(?s)\s(?=(.{{{chars}}}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def line_keys(lines: DataFrame, chars: int = 9, bins: int = 9, rows: int = 4) -> DataFrame:
    """``lines`` and keys: of the shingles that start a word where there are many, of all shingles where there are few.

    Lines with ``_FEW`` starts at least, one in 16 characters or more, have keys
    of their starts only. Starts count from two thirds of that on, so that a
    line on either side of the border meets its like on the other.
    """
    names = lines.columns
    marked = lines.withColumn("__w", starts(F.col("line"), chars))
    n = F.size("__w")
    some = with_bands(marked, F.when(n >= _FEW * 2 // 3, F.col("__w")), _STARTS_BINS, _STARTS_ROWS, _STARTS_ROWS).withColumnRenamed("keys", "__k")
    every = with_bands(some, F.when((n < _FEW) | (F.length("line") > 16 * n), shingles(F.col("line"), chars)), bins, rows)
    return every.select(*names, F.array_compact(F.concat("__k", "keys")).alias("keys"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, th (these two name the document), pos, line (normalised) and h1, h2 of every line that is not blank."""
    line = F.lower(F.trim(F.col("line")))
    # named before the lines are made, or each of them would carry its text
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    rows = texts.select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc", "th", "pos", line.alias("line")).filter(F.col("line") != "")
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def one_each(docs: DataFrame, seen: DataFrame, ids: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """h1 and line, once for each h1 of ``ids``: of its places in ``seen`` one is looked up, so that few texts are cut into lines again."""
    place = F.xxhash64("doc", "th", "pos")
    of = seen.select("h1", "doc", "th", "pos", place.alias("o")).join(_small(ids, most_rows), "h1", "left_semi")
    of = of.groupBy("h1").agg(*[F.min_by(c, "o").alias(c) for c in ("doc", "th", "pos")])
    at = keep(of.groupBy("doc", "th").agg(F.collect_list(F.struct("h1", "pos")).alias("at")).withColumnRenamed("doc", "of_doc"), "places")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    met = texts.join(_small(at, most_rows), "th").filter(F.col("doc").eqNullSafe(F.col("of_doc")))
    met = met.select("at", F.split("text", "\n", -1).alias("parts")).select(F.explode(F.transform("at", lambda a: F.struct(a["h1"].alias("h1"), F.get("parts", a["pos"]).alias("line")))).alias("l"))
    return met.select("l.h1", F.lower(F.trim("l.line")).alias("line")).dropDuplicates(["h1"])


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; it is a kept table."""
    return F.broadcast(df) if df.count() <= most else df


def banded(keyed: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """key and h1, once each, of all keys that different lines share. keyed: h1 (may repeat) and keys."""
    each = keyed.select("h1", F.explode("keys").alias("key")).filter("key IS NOT NULL")
    # two numbers a key, summed before they are shuffled; nearly all keys end here
    shared = keep(each.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least <> most").select("key"), "shared")
    out = keep(each.join(_small(shared, most_rows), "key").distinct(), "bands")
    drop_kept(out.sparkSession, shared)
    return out


def candidates(bands: DataFrame, whole: int = 8) -> tuple[DataFrame, DataFrame]:
    """a < b (h1 of two lines): pairs that share a band; and key and h1 of the groups of over ``whole`` lines, which are paired with anchors only."""
    order = lambda c, k: F.xxhash64(F.lit(k), c)
    groups = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("least"), F.max("h1").alias("most"))
    met = keep(bands.join(groups.filter("n > 2"), "key"), "met")
    few = met.filter(F.col("n") <= whole).groupBy("key").agg(F.collect_list("h1").alias("all"))
    few = few.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    many = met.filter(F.col("n") > whole)
    more = many.groupBy("key").agg(F.min_by("h1", order("h1", 1)).alias("x"), F.min_by("h1", order("h1", 2)).alias("y"))
    tied = many.join(more, "key").select("h1", F.explode(F.array_distinct(F.array("least", "most", "x", "y"))).alias("other")).filter("h1 <> other")
    tied = tied.select(F.least("h1", "other").alias("a"), F.greatest("h1", "other").alias("b"))
    pairs = groups.filter("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b")).unionByName(few).unionByName(tied)
    out, large = keep(pairs.distinct(), "pairs"), keep(many.select("key", "h1"), "large")
    drop_kept(out.sparkSession, met)
    return out, large


def open_groups(large: DataFrame, same: DataFrame) -> DataFrame:
    """key, h1 and c (the component) of the lines in those groups that still hold several components."""
    named = large.join(same, F.col("h1") == F.col("node"), "left").select("key", "h1", F.coalesce("component", "h1").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    return keep(named.join(several, "key", "left_semi"), "open")


def _parities(rows: DataFrame, words: int = 16) -> DataFrame:
    """h1 and that many words of 64 bits, each bit the parity of how many of the set ``x`` fall on it: two sets differ in as many members at least as their words in bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright("t", 8), F.lit(64)).cast("int"))
    word = lambda k: F.coalesce(F.bit_xor(F.when(F.pmod("t", F.lit(words)) == k, bit)), F.lit(0).cast("long"))
    return rows.select("h1", F.explode("x").alias("t")).groupBy("h1").agg(*[word(k).alias(f"w{k}") for k in range(words)])


def across(sets: DataFrame, groups: DataFrame, of: Callable[[Column], Column], similarity: float) -> DataFrame:
    """a and b: all links between different components among the lines of ``groups`` (key, h1, c).

    A line is listed under the first of its shingles, rare ones first, so many
    that a similar line must share one. Any fixed order is exact; this one goes
    by counts over ``_BUCKETS`` buckets of shingles, which is what is broadcast.
    Under each shingle, only lines outside its most frequent component look for
    partners, so that a large group of near copies is not paired with itself.
    Pairs meet only where sizes, positions and parities leave room for a link.
    """
    spark = groups.sparkSession
    rows = keep(groups.select("h1", "c").distinct().join(sets, "h1").select("h1", "c", "n", F.array_distinct(of(F.col("x"))).alias("x")), "sets")
    words = keep(_parities(rows), "parities")
    some = _small(words, _BUCKETS // 16)
    own = ("h1", "c", "n")
    each = rows.select(*own, F.explode("x").alias("t")).withColumn("bucket", F.pmod("t", F.lit(_BUCKETS)))
    counts = each.groupBy("bucket").agg(F.count("*").alias("m"))
    ranked = each.join(F.broadcast(counts), "bucket").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("m", "t"))).alias("s"))
    prefix = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    firsts = keep(ranked.select(*own, F.posexplode(F.slice(F.col("s.t"), F.lit(1), prefix)).alias("i", "t")), "firsts")
    main = firsts.groupBy("t", "c").agg(F.count("*").alias("k")).groupBy("t").agg(F.max_by("c", F.struct("k", "c")).alias("c0"), F.count("*").alias("k")).filter("k > 1").select("t", "c0")
    met = keep(firsts.join(main, "t"), "met")
    side = lambda d, k: d.join(some, "h1").select("t", *[F.col(c).alias(f"{c}{k}") for c in (*own, "i", *words.columns[1:])])
    need = similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    fits = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need
    unlike = sum((F.bit_count(F.col(f"w{k}a").bitwiseXOR(F.col(f"w{k}b"))) for k in range(len(words.columns) - 1)), F.lit(0))
    fits &= unlike <= F.col("na") + F.col("nb") - 2 * need
    pairs = side(met.filter("c <> c0"), "a").join(side(met, "b"), "t").filter((F.col("ca") != F.col("cb")) & fits)
    pairs = keep(pairs.select(F.least("h1a", "h1b").alias("a"), F.greatest("h1a", "h1b").alias("b")).distinct(), "pairs")
    out = keep(links(rows, pairs, lambda x: x, similarity), "across")
    for x in (rows, words, firsts, met, pairs):
        drop_kept(spark, x)
    return out


def links(sets: DataFrame, pairs: DataFrame, of: Callable[[Column], Column], similarity: float) -> DataFrame:
    """The pairs whose sets have at least this Jaccard similarity."""
    side = lambda k: sets.select(F.col("h1").alias(k), F.col("n").alias(f"n{k}"), F.col("x").alias(f"x{k}"))
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes)
    common = both.select("a", "b", "na", "nb", F.size(F.array_intersect(of(F.col("xa")), of(F.col("xb")))).alias("common"))
    return common.filter(F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _joined(same: DataFrame, further: DataFrame) -> DataFrame:
    return keep(connected_components(same.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(further)), "same")


def similar(keyed: DataFrame, sets: Callable[[DataFrame], DataFrame], of: Callable[[Column], Column], similarity: float, whole: int = 8) -> DataFrame:
    """node and component for each h1 of ``keyed`` (h1, keys) that links to another by a shared key.

    ``sets`` gives, for a table of h1, h1 with n, the size of its set, and x, of which ``of`` makes the set.
    """
    spark = keyed.sparkSession
    bands = banded(keyed)
    pairs, large = candidates(bands, whole)
    ids = keep(bands.select("h1").distinct(), "ids")
    known = keep(sets(ids), "known")
    found = keep(links(known, pairs, of, similarity), "links")
    same = keep(connected_components(found), "same")
    for x in (bands, pairs, ids, found):
        drop_kept(spark, x)
    if large.isEmpty():
        return same
    groups = open_groups(large, same)
    if groups.isEmpty():
        return same
    found = across(known, groups, of, similarity)
    return same if found.isEmpty() else _joined(same, found)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + n for n in names]


def dedup_lines(docs: DataFrame, similarity: float = 0.8, chars: int = 9, bins: int = 9, rows: int = 4, whole: int = 8, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` with the lines that stay as text, and n_lines, n_removed."""
    lines = lines_of(docs)
    # hashes and keys of all lines, worked out in one scan of the texts
    seen = keep(line_keys(lines, chars, bins, rows).drop("line"), "lines")

    def sets(ids: DataFrame) -> DataFrame:
        some = one_each(docs, seen, ids, most_rows)
        return some.select("h1", F.size(F.array_distinct(shingles(F.col("line"), chars))).alias("n"), F.col("line").alias("x"))

    same = similar(seen.select("h1", "keys"), sets, lambda x: shingles(x, chars), similarity, whole)
    # one number for a line's place, by doc, text and position, so that the least of them is a hash aggregate
    wide = lambda c: c.cast("decimal(38,0)")
    doc = F.coalesce(F.col("doc"), F.lit(-(1 << 63)))
    place = (wide(doc) * wide(F.lit(1 << 62)) + wide(F.pmod(F.col("th"), F.lit(1 << 31)) * F.lit(1 << 31) + F.col("pos"))).cast("decimal(38,0)")
    seen = seen.select("doc", "th", "pos", "h1", "h2", place.alias("place"))
    first = seen.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    first = keep(first.join(same, F.col("h1") == F.col("node"), "left").filter("n > 1 OR component IS NOT NULL").select("h1", "h2", "place", "component"), "first")
    # a component may hold very many lines: these meet its lead in several parts
    lead = first.filter("component IS NOT NULL").groupBy("component").agg(F.min("place").alias("lead"))
    lead = lead.select("component", "lead", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    part = first.withColumn("salt", F.pmod(F.col("h1"), F.lit(_SALTS)).cast("int"))
    stays = part.join(lead, ["component", "salt"], "left").select("h1", "h2", F.coalesce("lead", "place").alias("stays"))
    gone = seen.join(stays, ["h1", "h2"]).filter(F.col("place") != F.col("stays"))
    k_doc, k_th, of_doc, of_th, k_gone = _free(docs, "doc", "th", "of_doc", "of_th", "gone")
    gone = gone.groupBy(F.col("doc").alias(of_doc), F.col("th").alias(of_th)).agg(F.collect_set("pos").alias(k_gone))
    passed = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    met = docs.select(*[F.col(f"`{c}`") for c in passed], F.col("doc_id").cast("long").alias(k_doc), F.xxhash64("text").alias(k_th))
    met = met.join(gone, F.col(k_doc).eqNullSafe(F.col(of_doc)) & (F.col(k_th) == F.col(of_th)), "left")
    parts = F.split("text", "\n", -1)
    stay = _let(parts, lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(k_gone)), lambda i: F.get(p, i)))
    text = F.when(F.col(k_gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return met.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in passed],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(k_gone), F.lit(0)).cast("long").alias("n_removed"),
    )
