"""Latency and throughput figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feed import running

#: Stretches of the range of values that are sorted apart.
STRETCHES = 64


def _at_ranks(df: DataFrame, key: str, value: str, index: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each key how many values it has, and its values at some places of their order, from 0.

    Equal values are counted first. Places follow from running counts in two levels: inside
    stretches of the range of values, which a sketch of all values cuts, and over the stretches'
    totals. So a key's distinct values are sorted by as many tasks as there are stretches.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = df.agg(F.percentile_approx(value, [k / STRETCHES for k in range(1, STRETCHES)], 1000)).first()[0] or []
    stretch = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    ranked = running(counted, key, [value], stretch, F.col("_n"), "_upto")
    total = counted.groupBy(key).agg(F.sum("_n").alias("n"))
    picks = [F.min(F.when(F.col("_upto") > at(F.col("n")), F.col(value))).alias(name) for name, at in index.items()]
    return ranked.join(total, key).groupBy(key).agg(F.max("n").alias("n"), *picks)


def lower_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index floor((n - 1) * q) of the sorted values."""
    return _at_ranks(df, key, value, {name: lambda n, q=q: F.floor((n - 1) * q) for name, q in shares.items()})


def upper_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index ceil(n * p) - 1, another rule than A6."""
    return _at_ranks(df, key, value, {name: lambda n, p=p: F.greatest(F.ceil(n * p) - 1, F.lit(0)) for name, p in shares.items()})


def summary(commits: DataFrame, key: str) -> DataFrame:
    """Events, commits, conflicts, mean batch, and rate over the time they span."""
    span = (F.unix_micros(F.max("last_at").cast("timestamp")) - F.unix_micros(F.min("first_at").cast("timestamp"))) / 1e6
    out = commits.groupBy(key).agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("commits"), F.sum("conflicts").alias("conflicts"), span.alias("seconds"))
    return out.withColumn("mean_batch", F.round(F.col("events") / F.greatest("commits", F.lit(1)), 4)).withColumn("per_second", F.round(F.col("events") / F.greatest("seconds", F.lit(1e-6)), 6)).drop("seconds")


def chaos_report(outcomes: DataFrame, key: str) -> DataFrame:
    """What became of the operations (outcome) of a run under faults. A violation is an
    acknowledged operation that the history lacks (kept is false)."""
    one = lambda name: F.count_if(F.col("outcome") == name)
    lost = F.count_if((F.col("outcome") == "acked") & ~F.col("kept"))
    return outcomes.groupBy(key).agg(one("acked").alias("acked"), one("failed").alias("clean_failures"), one("fault").alias("faults"), one("ambiguous").alias("ambiguous"), lost.alias("violations"))
