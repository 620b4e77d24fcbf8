"""The set-based pass against a table of decisions for each number of each novel."""

import datetime as dt
import random

import pytest

from serialloom.functions.text import GATE_PHRASES
from serialloom.operators.reconcile import divergence, sync_pass, with_priority
from serialloom.sources import schemas

NOW = dt.datetime(2002, 1, 1)
STUB = ["Please " + GATE_PHRASES[1]]


def decide(number, by, gap, listed, wanted):
    """What becomes of one number: who holds it, whether it is a gap, and what is counted.

    by: who holds it now; listed: {rank: (source, outcome)} of the sources that list it; wanted: whether it is to be fetched.
    """
    good = sorted(r for r, (_, o) in listed.items() if o in ("ok", "stub"))
    main = listed.get(1, (None, None))
    counted = set()
    if wanted:
        if good:
            by = listed[good[0]][0]
            counted |= {"fetched", *(["fallback"] if good[0] > 1 else [])}
        elif listed and main[1] != "not_found":
            counted.add("failed")
        gap = {"not_found": True}.get(main[1], gap and good[:1] != [1])
    table = {"ok": (main[0], gap, {"upgraded"}), "stub": (by, True, set()), "not_found": (by, True, set()), "error": (by, gap, set())}
    if by is not None and not gap and 1 in listed and by != main[0]:
        by, gap, more = table[main[1]]
        counted |= more
    return by, gap, counted


def expected(case, limit):
    """A pass over one novel: what is decided for each of its numbers, and what follows from all of them."""
    top = max(case["have"], default=0)
    fresh = [n for _, _, window in case["sources"] for n in window if n > top]
    whole = case["state"] == "backfilling" or (fresh and min(fresh) != top + 1)
    lists = {r: (s, full if whole else window) for r, (s, full, window) in enumerate(case["sources"], 1)}
    target = {n for _, x in lists.values() for n in x}
    wanted = sorted(target - set(case["have"]))[: limit or None]
    every = target | set(case["have"]) | set(case["gaps"])
    out = {n: decide(n, case["have"].get(n), n in case["gaps"], {r: (s, case["outcome"][s, n]) for r, (s, x) in lists.items() if n in x}, n in wanted) for n in every}
    have, gaps = {n: by for n, (by, _, _) in out.items() if by is not None}, {n for n, (_, g, _) in out.items() if g}
    count = {k: sum(k in c for *_, c in out.values()) for k in ("fetched", "fallback", "failed", "upgraded")}
    if case["state"] == "backfilling":
        state = "live" if target and target <= set(have) | gaps else "backfilling"
    else:
        state = "live" if count["fetched"] else case["state"]
    return {"have": have, "gaps": gaps, "state": state, "open": sorted(gaps - set(have)), **count}


def make(rng, novel):
    sources, outcome = [], {}
    for k in range(rng.randint(1, 3)):
        s = novel * 10 + k
        full = sorted(n for n in range(1, 8) if rng.random() < 0.8)
        sources.append((s, full, full[-rng.randint(1, 3) :]))
        for n in full:
            outcome[s, n] = rng.choices(["ok", "not_found", "error", "stub"], [6, 2, 1, 1])[0]
    have = {n: rng.choice(sources)[0] for n in range(1, rng.randint(1, 6)) if rng.random() < 0.8}
    gaps = {n for n in range(1, 8) if rng.random() < 0.1}
    return {"state": rng.choice(["backfilling", "live", "likely_complete"]), "have": have, "gaps": gaps, "sources": sources, "outcome": outcome}


@pytest.mark.parametrize("limit", [0, 2])
def test_sync_pass_decides_as_the_table(spark, limit):
    rng = random.Random(limit)
    cases = {i: make(rng, i) for i in range(1, 121)}
    novels = spark.createDataFrame([(i, f"n{i}", None, None, None, "unknown", c["state"], False, NOW, NOW) for i, c in cases.items()], schemas.NOVELS)
    sources = spark.createDataFrame([(s, i, "s", f"u{s}", k, None, None) for i, c in cases.items() for k, (s, _, _) in enumerate(c["sources"], 1)], schemas.SOURCES)
    chapters = spark.createDataFrame([(i, n, "t", "b", s, NOW, True, NOW) for i, c in cases.items() for n, s in c["have"].items()], schemas.CHAPTERS)
    gaps = spark.createDataFrame([(i, n, NOW) for i, c in cases.items() for n in c["gaps"]], schemas.GAPS)
    seen = spark.createDataFrame([(i, s, mode, n, n, "t", "u") for i, c in cases.items() for s, full, window in c["sources"] for mode, x in (("full", full), ("latest", window)) for n in x], schemas.DISCOVERED)
    paragraphs = {"ok": ["good"], "stub": STUB}
    fetched = spark.createDataFrame([(i, s, n, "ok" if o == "stub" else o, "t", paragraphs.get(o), None) for i, c in cases.items() for (s, n), o in c["outcome"].items()], schemas.FETCHED)
    got = sync_pass(novels, sources, chapters, gaps, seen, fetched, NOW, limit)
    held, open_, report = {}, {}, {r.novel_id: r for r in got.report.collect()}
    for r in got.chapters.collect():
        held.setdefault(r.novel_id, {})[r.number] = r.source_id
    for r in got.gaps.collect():
        open_.setdefault(r.novel_id, []).append(r.number)
    for i, c in cases.items():
        want, r = expected(c, limit), report[i]
        assert held.get(i, {}) == want["have"], i
        assert sorted(open_.get(i, [])) == sorted(want["gaps"]), i
        assert (r.new_state, r.newly_fetched, r.from_fallback, r.failed, r.upgraded, r.gaps) == (want["state"], want["fetched"], want["fallback"], want["failed"], want["upgraded"], want["open"]), i
        # whatever is decided: nothing that was held is lost, gaps that are told are open, and a title is live only if it may be
        assert set(c["have"]) <= set(held.get(i, {})) and set(r.gaps) == set(open_.get(i, [])) - set(held.get(i, {}))
        assert r.from_fallback <= r.newly_fetched <= r.target and len(held.get(i, {})) == len(c["have"]) + r.newly_fetched


def test_divergence(spark):
    seen = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 3, 4)], "novel_id bigint, source_id bigint, number bigint")
    src = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id bigint, priority bigint")
    got = divergence(with_priority(seen, src)).collect()
    assert [(r.novel_id, r.hi, r.lo, r.detail) for r in got] == [(1, 5, 3, "1=5, 2=3")]


def test_a_pass_over_dealt_tables_shuffles_no_number_again(spark, tmp_path):
    """What is decided of a number is found in the tasks that have its novel: lines are dealt once for each use, and nothing but that."""
    from serialloom.operators import reconcile
    from serialloom.plans.catalog import QUERIES

    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "1D AS o_totalprice", "TIMESTAMP '2000-01-01' AS o_orderdate", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    lines = ["id % 40 AS l_orderkey", "id AS l_partkey", "id % 3 AS l_suppkey", "CAST(id % 5 AS INT) AS l_linenumber", "1D AS l_quantity", "1D AS l_extendedprice", "IF(id % 4 = 0, 'R', 'N') AS l_returnflag", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus", "TIMESTAMP '2000-01-01' AS l_shipdate"]
    spark.range(200).selectExpr(*lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, keep = {}, reconcile.keep
    reconcile.keep = lambda df, what: (plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString()), keep(df, what))[1]
    try:
        assert QUERIES["sync_pass"](spark, str(tmp_path)).count() == 40
    finally:
        reconcile.keep = keep
    exchanged = [x for x in plans["numbers"].splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]
    assert all("number" not in x for x in exchanged), exchanged
