"""Labels, states and outcomes, and the arithmetic of delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, trim_all

# The labels that sites use.
ONGOING_LABELS = ("1", "ongoing", "on going", "serializing", "active", "releasing")
COMPLETED_LABELS = ("2", "completed", "complete", "finished")
STATES = ("backfilling", "live", "likely_complete")
RETRYABLE = (429, 500, 502, 503, 504)
NOT_FOUND = (404, 410)
DAY = 86_400


def status_hint(label: Column) -> Column:
    """ongoing, completed or unknown; a hiatus or a dropped title is unknown on purpose."""
    s = ascii_lower(trim_all(label))
    return F.when(s.isin(*ONGOING_LABELS), "ongoing").when(s.isin(*COMPLETED_LABELS), "completed").otherwise("unknown")


def first_known(labels: Column) -> Column:
    """The first label of an array that says something."""
    return F.coalesce(F.get(F.filter(F.transform(labels, status_hint), lambda s: s != "unknown"), F.lit(0)), F.lit("unknown"))


def parse_status(stored: Column) -> Column:
    return F.when(stored.isin("ongoing", "completed"), stored).otherwise("unknown")


def parse_state(stored: Column) -> Column:
    """Anything unknown is taken for backfilling."""
    return F.when(stored.isin(*STATES), stored).otherwise("backfilling")


def outcome(code: Column) -> Column:
    """ok, not_found or error, from an HTTP status."""
    return F.when(code.isin(*NOT_FOUND), "not_found").when(code.between(200, 299), "ok").otherwise("error")


def is_retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def retry_after(header: Column) -> Column:
    """Seconds; a date gives null."""
    n = F.regexp_extract(trim_all(header), "^[0-9]+$", 0).try_cast("bigint")
    return n


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    return F.least(F.lit(most).cast("long"), F.lit(base) * F.shiftleft(F.lit(1).cast("long"), 1) * F.pow(F.lit(2.0), F.least(attempt, F.lit(15))).cast("long"))


def next_delays(outcomes: Column, base: float, most: float) -> Column:
    """The delay after each outcome: doubled up to ``most`` on an error, eased by 0.85 down to ``base`` otherwise."""
    start = F.struct(F.lit(float(base)).alias("d"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, ok: Column) -> Column:
        d = F.when(ok, F.greatest(F.lit(float(base)), a["d"] * 0.85)).otherwise(F.least(F.lit(float(most)), a["d"] * 2))
        return F.struct(d.alias("d"), F.concat(a["out"], F.array(d)).alias("out"))

    return F.aggregate(outcomes, start, step, lambda a: a["out"])
