"""Substring dedup, SimHash, decontamination and line dedup against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from serialloom.llm import components, decontam, lines, simhash, substrings
from serialloom.llm.tokens import Words, pack, rolling, unpack


def key(i):
    return -(1 << 63) if i is None else i


def test_words_and_hashes():
    given = ["Hello  world\tfoo", None, "", " a b ", "é" * 40 + " x", "z" * 300 + " yq", "same same"]
    w = Words(pa.array(given))
    got = [w.buf[s : s + n].tobytes() for s, n in zip(w.starts, w.lens)]
    want = [x for t in given for x in (t or "").encode().split()]
    assert got == want
    by = {}
    for word, h in zip(got, w.hashes().tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    assert [w.text_of(i) for i in range(len(given))] == [" ".join((t or "").split()) for t in given]


def test_rolling_hash_is_rabin_karp():
    x = np.arange(3, 80, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b, m = 0xD6E8FEB86659FD93, 1 << 64
    for k in (1, 2, 3, 7, 16, 20, 77, 78):
        want = [sum(int(x[i + j]) * pow(b, k - 1 - j, m) for j in range(k)) % m for i in range(max(0, len(x) - k + 1))]
        assert rolling(x, k).tolist() == want
    for v in ([], [0], [255, 256], [1 << 40]):
        assert unpack(pack(np.array(v, np.uint64))).tolist() == v


def removed(texts, width):
    """The words that stay, document by document."""
    docs = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(words) >= len(docs.get(key(i), [])):  # of the rows without an id, one is empty
            docs[key(i)] = words
    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        for k in range(len(docs[i]) - width + 1):
            if first.setdefault(tuple(docs[i][k : k + width]), (i, k)) != (i, k):
                gone[i] |= set(range(k, k + width))
    return docs, gone


def test_substring_dedup(odd_docs, texts):
    docs, gone = removed(texts, 5)
    got = substrings.dedup_substrings(odd_docs, 5).collect()
    assert len(got) == len(texts)
    for r in got:
        k = key(r.doc_id)
        if r.doc_id is None and not r.n_words:
            assert r.kept == ""
            continue
        assert r.n_words == len(docs[k]) and r.n_removed == len(gone[k])
        assert r.kept == " ".join(w for j, w in enumerate(docs[k]) if j not in gone[k])
        assert sum(s["to"] - s["from"] for s in r.removed) == r.n_removed


def test_substring_dedup_of_nothing(no_docs):
    assert substrings.dedup_substrings(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 7), (7, 300), (5, 5), (300, 100)] + [(1000, 1000 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    want = {i: 10 for i in range(10, 41)} | {7: 7, 100: 7, 300: 7} | {i: 1000 for i in range(1000, 1030)}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def fingerprint(t, words=3):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    n = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def plain_components(fps, distance):
    """doc ids by index; the smallest id that each reaches."""
    x = np.array([f for _, f in fps], np.uint64)
    label = list(range(len(x)))
    changed = True
    while changed:
        changed = False
        for i in range(len(x)):
            near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= distance)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    least = {}
    for (i, _), c in zip(fps, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in label]


def test_simhash(odd_docs, texts):
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd_docs).collect())
    fps = [(i, fingerprint(t)) for i, t in texts]
    assert got == Counter((i, f, c) for (i, f), c in zip(fps, plain_components(fps, 3)))


def test_simhash_splits_hot_groups(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for _ in range(300)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, node bigint")
    for hot in (10, 8192):
        found = components.connected_components(simhash.links(simhash.block_keys(nodes, 3, 5, hot), 3))
        got = {r.node: r.component for r in found.collect()}
        want = plain_components([(i, f) for i, f in enumerate(fps)], 3)
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash_links_over_rows_without_an_id(spark, monkeypatch):
    """5 and 9 differ in four bits and reach each other over the row without an id, which takes their component; another such row has none."""
    fps = spark.createDataFrame([(5, 0), (None, 3), (9, 15), (None, 1 << 62 | 0xFFFF00)], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fps)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(fps).collect()}
    assert got == {(5, 0): 5, (None, 3): 5, (9, 15): 5, (None, 1 << 62 | 0xFFFF00): None}


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_substrings_of_rows_that_repeat_an_id(spark):
    a, b = " ".join("abcdefgh"), " ".join("stuvwxyz")
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a + " tail"), (None, b + " end")]
    got = sorted(((r.doc_id, r.kept) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()), key=repr)
    assert got == sorted([(1, ""), (2, ""), (2, ""), (2, ""), (None, a + " tail"), (None, b + " end")], key=repr)
    rows = [(1, a), (2, a), (2, b)]
    got = sorted((r.doc_id, r.kept) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect())
    assert got == [(1, a), (2, ""), (2, b)]


def decontaminated(texts, items, n):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + min(n, len(w))]), set()).add(i)
    out = []
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def test_decontamination(spark, odd_docs, texts):
    items = [(1, texts[1][1][10:90].upper()), (2, "one"), (3, None), (4, "!!"), (10, texts[1][1][10:90] + " more of it"), (2, "one"), (None, "two")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, hash int")
    want = decontaminated(texts, items, 4)
    for most in (2_000_000, 0):  # broadcast, and shuffled
        got = decontam.decontaminate(odd_docs, bench, 4, most)
        assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == want


def test_decontamination_of_and_with_nothing(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.decontaminate(odd_docs, bench).filter("n_hit > 0").count() == 0
    assert decontam.decontaminate(odd_docs, bench).count() == odd_docs.count()
    assert decontam.decontaminate(no_docs, bench).count() == 0


def test_decontamination_of_very_long_texts(spark):
    """Windows carry no words: four texts of 200,000 words, in either way."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(200_000))) for i in range(4)]
    cut = texts[2][1].split(" ")
    bench = spark.createDataFrame([(1, " ".join(cut[150_000:150_012])), (2, "not there at all")], "item_id bigint, text string")
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    for most in (2_000_000, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in decontam.decontaminate(docs, bench, 10, most).collect()}
        assert got == {i: (200_000, 12 * (i == 2), [(150_001, 150_012)] * (i == 2), ["1"] * (i == 2)) for i in range(4)}


def test_documents_do_not_meet_in_one_task_where_windows_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y z") for i in range(4000)], "doc_id bigint, text string")
    known = spark.createDataFrame([(1, 3)], "hash bigint, size int")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        met = [r["count"] for r in decontam.probed(docs, known, [3], False).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(met) == 4000 and len(met) == 8 and max(met) < 2 * 4000 / 8


def test_decontamination_tells_repeated_ids_apart(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "x y z"), (7, "a b c"), (7, "q"), (7, "q")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in decontam.decontaminate(docs, bench).collect())
    assert got == [("7", 1, 0), ("7", 1, 0), ("7", 3, 3), ("None", 3, 0), ("None", 4, 3)]


def test_remove_spans(spark):
    row = spark.range(1).select(decontam.remove_spans(F.split(F.lit("a b c d e"), " "), F.array(F.struct(F.lit(2).alias("from"), F.lit(3).alias("to")))).alias("x")).first()
    assert row.x == ["a", "d", "e"]


def test_decontamination_is_native(spark, odd_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    for df in (decontam.decontaminate(odd_docs, bench), lines.lines_of(odd_docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def line_set(line, chars=9):
    """A line's shingles at every position."""
    return {line[k : k + chars] for k in range(max(1, len(line) - chars + 1))}


def plain_lines(rows, similarity=0.8):
    occurrences = []
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if n := x.strip(" ").lower():
                occurrences.append((key(i), p, n))
    occurrences.sort()
    names = list(dict.fromkeys(n for _, _, n in occurrences))
    sets, label = [line_set(n) for n in names], list(range(len(names)))
    tied = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    while True:
        before = label[:]
        for a, b in tied:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    lead, gone, of = {}, {}, {n: x for n, x in zip(names, label, strict=True)}
    for i, p, n in occurrences:
        if lead.setdefault(of[n], (i, p)) != (i, p):
            gone.setdefault(i, set()).add(p)
    return gone


def left(rows, gone):
    return sorted(((i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(key(i), ())), len(gone.get(key(i), ()))) for i, t in rows), key=repr)


def test_line_dedup(spark):
    words = "the quick brown fox jumps over lazy dogs while seven small wizards watch from beyond northern gates and count each passing cloud".split()
    line = " ".join(words)
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in range(len(words))]
    rows = [(1, line + "\n\nown line one"), (2, "  " + line.upper() + " \n" + near[3]), (3, near[15] + "\nown line two\nown line one"), (4, None), (5, ""), (6, "\n\n"), (7, line), (7, line), (-3, near[0]), (9, "x " * 20_000), (10, "a\nb\na")]
    docs = spark.createDataFrame([(i, t, 5, "g", 0, "h", 1) for i, t in rows], "doc_id bigint, text string, pos int, gone string, N_Lines int, __gone string, component int")
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "pos", "gone", "__gone", "component", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=repr)
    assert got == left(rows, plain_lines(rows))


def test_line_dedup_against_all_pairs(spark):
    """Lines of several alphabets and lengths, edited by characters and words: of the lines that all pairs would remove, 0.98 go, and no other."""
    rng = random.Random(11)
    word = lambda abc: "".join(rng.choice(abc) for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(160):
        abc = ("abcdefgh", "今天气很好我们去公园", "0123456789-/:", "äöüß𝒳𝒴🙂e")[i % 4]
        base = (" " if i % 3 else "").join(word(abc) for _ in range(rng.choice((4, 8, 20, 60))))
        for _ in range(4):
            x = list(base)
            for _ in range(rng.randint(0, 1 + len(x) // 60)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 2)] = rng.choice(abc)
            rows.append((len(rows), "".join(x)))
    want = plain_lines(rows)
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("n_removed > 0").collect()}
    assert got <= {i[1] if isinstance(i, tuple) else i for i in want} and len(got) >= 0.98 * len(want) > 200


def test_lines_that_differ_inside_long_words_stay(spark):
    pairs = [
        ("https://www.alpha.org/a/1", "https://www.zebra.net/q/99"),
        ("2024-01-01T10:00:00Z", "2024-01-02T23:59:59Z"),
        ("order: 123456789-0001 paid", "order: 123456789-7777 paid"),
        ("今天天气非常好我们去公园散步然后回家吃饭", "今天天气非常好我们在图书馆里看了一整天书"),
        ("abc\u2028defghi one", "abc\u2028xyzuvw two"),
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(x for p in pairs for x in p)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(docs).collect()} == dict.fromkeys(range(2 * len(pairs)), 0)


@pytest.mark.parametrize("whole", [4, 32])
def test_all_lines_of_a_large_group_are_compared(spark, whole):
    """Lines that all share a band: each of 100 has one near copy, which is unlike all others."""
    sets = {}
    for g in range(100):
        own = [10_000 + 100 * g + k for k in range(20)]
        sets |= {2 * g: sorted([*own, 1, 2, g]), 2 * g + 1: sorted([*own, 1, 3, g])}
    assert joined(spark, sets, [7], whole) == {i: i - i % 2 for i in sets}


def joined(spark, sets, keys, whole=8):
    both = spark.createDataFrame([(i, keys, len(s), s) for i, s in sets.items()], "h1 bigint, keys array<bigint>, n int, x array<bigint>")
    got = lines.similar(both.select("h1", "keys"), lambda ids: both.join(ids, "h1", "left_semi").select("h1", "n", "x"), lambda x: x, 0.8, whole)
    return {r.node: r.component for r in got.collect()}


def test_a_group_of_thousands_that_are_similar_in_pairs_only(spark):
    sets = {i: [1, 2, 3, *range(100 * (i // 2 + 1), 100 * (i // 2 + 1) + 20), 10_000_000 + i] for i in range(5000)}
    assert joined(spark, sets, [7]) == {i: i - i % 2 for i in sets}


def test_a_large_group_at_the_limit_loses_nothing(spark):
    """One band of 5,000 lines: pairs at exactly 0.8, pairs just below it, and a thousand copies of one line that differ from it by one shingle."""
    sets = {}
    for i in range(2000):
        own = [1000 * (i // 2 + 1) + k for k in range(15)]
        # of 18 shingles, 16 are shared by an even pair (16 of 20) and 15 by an odd one (15 of 21)
        more = [1, 10_000_000 + 3 * i, 10_000_001 + 3 * i] if i // 2 % 2 == 0 else [10_000_000 + 3 * i + k for k in range(3)]
        sets[i] = own + more
    sets |= {i: [*range(100_000_000, 100_000_030), 200_000_000 + i] for i in range(2000, 5000)}
    assert joined(spark, sets, [7]) == {i: i - i % 2 for i in range(2000) if i // 2 % 2 == 0} | dict.fromkeys(range(2000, 5000), 2000)


def test_a_large_group_of_near_copies(spark):
    """One band, links along a chain that the anchors see little of, and lines that link to nothing."""
    sets = {i: list(range(i, i + 30)) for i in range(120)} | {1000 + i: [*range(2000 + 40 * i, 2025 + 40 * i), 5, 50] for i in range(60)}
    assert joined(spark, sets, [7, 8]) == dict.fromkeys(range(120), 0)


def test_bands_find_links_at_the_limit(spark):
    """Share of pairs of sets of random hashes, just at 0.8 or above, that share a key."""
    rng, rows = np.random.default_rng(3), []
    for n, d in ((18, 2), (22, 2), (30, 3), (60, 6), (200, 22)):
        for i in range(600):
            u = rng.integers(-(1 << 63), (1 << 63) - 1, n + d).tolist()
            rows.append((n, u[:n], u[d:]))
    both = spark.createDataFrame(rows, "n int, a array<bigint>, b array<bigint>")
    one = lines.with_bands(both, F.col("a"), 9, 4).withColumnRenamed("keys", "ka")
    two = lines.with_bands(one, F.col("b"), 9, 4)
    got = two.groupBy("n").agg(F.avg(F.arrays_overlap(F.array_compact("ka"), F.array_compact("keys")).cast("int")).alias("r")).collect()
    assert len(got) == 5 and all(r.r >= 0.985 for r in got), got


def prose_pairs(rng, count, letters, n):
    """Pairs of lines of words of 1 to that many letters, edited down to a Jaccard of 0.80 to 0.84."""
    abc, out = "abcdefghijklmnopqrstuvwxyz", []
    while len(out) < count:
        x = ""
        while len(x) < n:
            x += "".join(rng.choice(abc) for _ in range(rng.randint(1, letters))) + " "
        x, y = x.strip(), x.strip()
        likeness = lambda z: len(line_set(x) & line_set(z)) / len(line_set(x) | line_set(z))  # noqa: B023, E731
        while True:
            at = rng.randrange(len(y))
            z = (y[:at] + rng.choice(abc + " ") + y[at + rng.randint(0, 2) :]).strip()
            if likeness(z) < 0.8:
                break
            y = z
        if likeness(y) <= 0.84:
            out.append((x, y))
    return out


def test_lines_of_words_meet_by_the_starts_of_words(spark):
    """Of pairs at the limit, also of lines with about as many words as tell the two kinds of keys apart, at least 0.99 share a key."""
    rng = random.Random(7)
    pairs = [(k, *p) for k, (letters, n) in enumerate(((9, 150), (9, 190), (12, 360), (9, 900))) for p in prose_pairs(rng, 150, letters, n)]
    rows = spark.createDataFrame(pairs, "kind int, a string, b string")
    one = lines.line_keys(rows.withColumnRenamed("a", "line")).withColumnsRenamed({"line": "a", "keys": "ka", "b": "line"})
    got = lines.line_keys(one).groupBy("kind").agg(F.avg(F.arrays_overlap("ka", "keys").cast("int")).alias("r")).collect()
    assert len(got) == 4 and all(r.r >= 0.985 for r in got) and sum(r.r for r in got) >= 4 * 0.99, got


def test_lines_of_many_words_are_not_hashed_at_every_position(spark):
    """What differs behind the first nine letters of each word leaves the keys as they are, but for lines of few words and of very long ones."""
    of = lambda n, tail: " ".join(f"word{k:05d}{tail}" for k in range(n))
    rows = [(k, of(n, t)) for k, (n, t) in enumerate(((60, "abc"), (60, "xyz"), (12, "abc"), (12, "xyz"), (60, "abc" * 5), (60, "xyz" * 5)))]
    keys = {r.id: sorted(r["keys"]) for r in lines.line_keys(spark.createDataFrame(rows, "id int, line string")).collect()}
    assert keys[0] == keys[1] and keys[2] != keys[3] and keys[4] != keys[5] and 6 <= len(keys[0]) <= 9


def test_line_dedup_is_native(spark, odd_docs):
    found = []
    keep = lines.keep
    lines.keep = lambda df, what: (found.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, what))[1]
    try:
        found.append(lines.dedup_lines(odd_docs)._jdf.queryExecution().executedPlan().toString())
    finally:
        lines.keep = keep
    assert len(found) > 8 and not re.search("Python|Arrow|Pandas", "".join(found))


def test_line_dedup_of_nothing(no_docs):
    assert lines.dedup_lines(no_docs).count() == 0


def test_columns_pass_through(odd_docs):
    out = lines.dedup_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    assert out.agg(F.sum("size")).first()[0] == 2 * odd_docs.count()


def test_parities_tell_long_sets_apart(spark):
    """Sets of 500 at a Jaccard of 0.6: by the bound at 0.8 none may meet, and no two differ in more bits than members."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(20):
        shared, own = rng.integers(-(1 << 62), 1 << 62, 376), rng.integers(-(1 << 62), 1 << 62, 248)
        sets += [[*shared, *own[:124]], [*shared, *own[124:]]]
    rows = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(sets)], "h1 bigint, x array<bigint>")
    words = {r[0]: np.array(r[1:], np.int64) for r in lines._parities(rows).collect()}
    unlike = [int(np.bitwise_count((words[i] ^ words[i + 1]).view(np.uint64)).sum()) for i in range(0, len(sets), 2)]
    assert max(unlike) <= 248 and min(unlike) > 1000 - 2 * 0.8 / 1.8 * 1000
