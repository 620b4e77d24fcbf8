"""The stream of lives against the same events as a table, in several orders of arrival."""

import datetime as dt
import random

import pytest

from serialloom.streaming import lifecycle

T0 = dt.datetime(2001, 1, 1)


def events(rng):
    rows = []
    for novel in range(1, 25):
        days = sorted(rng.sample(range(90), rng.randint(1, 5)))
        rows += [(novel, T0 + dt.timedelta(days=d), "fetched", None) for d in days]
        if rng.random() < 0.8:
            rows.append((novel, T0 + dt.timedelta(days=days[0]), "caught_up", None))
        rows += [(novel, T0 + dt.timedelta(days=rng.randint(0, 90), hours=k), "labelled", rng.choice(["completed", "completed", "ongoing", None])) for k in range(rng.randint(0, 3))]
    rows += [(50, T0, "caught_up", None), (50, T0, "labelled", "completed"), (50, T0, "fetched", None)]
    return [*rows, (None, T0, "fetched", None), (50, None, "fetched", None)]


def run(spark, tmp_path, batches, name, late):
    spark.createDataFrame([], lifecycle.EVENTS).write.parquet(str(tmp_path / name / "in"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, lifecycle.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(lifecycle.EVENTS).parquet(str(tmp_path / name / "in"))
        out = lifecycle.states(stream, 30, late)
        q = out.writeStream.outputMode("update").foreachBatch(lambda df, k, i=i: df.write.mode("append").parquet(str(tmp_path / name / "out")))
        q.option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    told = {}
    for r in sorted(spark.read.parquet(str(tmp_path / name / "out")).collect(), key=lambda r: r["at"]):
        told.setdefault(r.novel_id, []).append(r.state)
    return told


@pytest.mark.parametrize("order", [0, 1])
def test_states_do_not_hang_on_the_order_of_arrival(spark, tmp_path, order):
    rows = events(random.Random(7))
    rows = rows[::-1] if order else rows
    half = len(rows) // 2
    clock = [(51, T0 + dt.timedelta(days=220), "caught_up", None)]  # moves the watermark on, past the others
    told = run(spark, tmp_path, [rows[:half], rows[half:], clock], f"o{order}", "120 days")
    table = spark.createDataFrame(rows + clock, lifecycle.EVENTS)
    want = {r.novel_id: r.state for r in lifecycle.states_at(table, T0 + dt.timedelta(days=100), 30).collect()}
    assert {n: s[-1] for n, s in told.items()} == want
    assert set(want.values()) == {"backfilling", "live", "likely_complete"} and want[50] == "likely_complete"


def test_a_timer_fires_without_an_event_and_a_chapter_revives(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    batches = [
        [(1, day(0), "caught_up", None), (1, day(0), "labelled", "completed"), (1, day(1), "fetched", None), (2, day(1), "fetched", None)],
        [(2, day(60), "fetched", None)],  # nothing of novel 1, but time goes on
        [(1, day(61), "fetched", None)],
    ]
    told = run(spark, tmp_path, batches, "t", "1 days")
    assert told == {1: ["live", "likely_complete", "live"], 2: ["backfilling"]}
