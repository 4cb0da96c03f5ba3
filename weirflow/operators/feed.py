"""Ordered feeds: numbering, reading, heads, chunks, trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 64


def running(df: DataFrame, key: str, order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` for each key, in two levels.

    ``bucket`` must not fall along ``order`` (the day of a time stamp, say). Sums run inside
    (key, bucket), a group as large as a bucket and no more, and are shifted by the totals of
    earlier buckets, which are one row per key and bucket. A key with a third of all rows is
    thus spread over as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(key, "_bucket").agg(F.sum("_value").alias("_total")).select(key, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    out = rows.withColumn("_inside", F.sum("_value").over(inside)).join(base, [key, "_bucket"])
    return out.withColumn(name, F.col("_base") + F.col("_inside")).drop("_bucket", "_value", "_inside", "_base")


def preceding(df: DataFrame, key: str, order: list[str], bucket: Column, values: dict[str, str]) -> DataFrame:
    """Values of the row before in each key, in two levels like ``running``: inside (key, bucket), and
    for a bucket's first row from the last row of the bucket before. ``values`` names new columns
    by those whose preceding value they hold; a key's first row has null."""
    rows = df.withColumn("_bucket", bucket)
    inside, over = Window.partitionBy(key, "_bucket").orderBy(*order), Window.partitionBy(key).orderBy("_bucket")
    last = rows.groupBy(key, "_bucket").agg(F.max_by(F.struct(*values.values()), F.struct(*order)).alias("_last"))
    base = last.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), F.lag("_last").over(over).alias("_base"))
    out = rows.withColumn("_nth", F.row_number().over(inside))
    for name, value in values.items():
        out = out.withColumn(name, F.lag(value).over(inside))
    out = out.join(base, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.col("_nth") == 1, F.col(f"_base.{value}")).otherwise(F.col(name)))
    return out.drop("_bucket", "_nth", "_key", "_at", "_base")


def assign_seq(df: DataFrame, key: str, order: list[str], bucket: Column, name: str = "seq") -> DataFrame:
    """Gapless numbers from 1 in each log."""
    return running(df, key, order, bucket, F.lit(1), name)


def assign_ranges(df: DataFrame, key: str, order: list[str], bucket: Column, n: Column) -> DataFrame:
    """First and last number of requests that hold several events each."""
    out = running(df.withColumn("n", n.cast("long")), key, order, bucket, F.col("n"), "last")
    return out.withColumn("first", F.col("last") - F.col("n") + 1)


def read_from(frames: DataFrame, start: int, trim: int = 0) -> DataFrame:
    """Frames from a position, in order. The floor is inclusive: it and all below are gone."""
    return frames.where((F.col("seq") >= start) & (F.col("seq") > trim)).orderBy("log", "seq")


def heads(frames: DataFrame, key: str = "log") -> DataFrame:
    """A1: last number of each log and the next one."""
    return frames.groupBy(key).agg(F.max("seq").alias("head_seq")).withColumn("next_seq", F.greatest(F.col("head_seq") + 1, F.lit(1)))


def head_of(frames: DataFrame, logs: DataFrame) -> DataFrame:
    """A1, A2: heads of named logs; a log without frames is at 0, next 1."""
    return logs.join(heads(frames), "log", "left").select("log", F.coalesce("head_seq", F.lit(0)).alias("head_seq"), F.coalesce("next_seq", F.lit(1)).alias("next_seq"))


def chunks(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """The zone map, a row for each run of ``size`` numbers."""
    return frames.groupBy("log", F.floor((F.col("seq") - 1) / size).cast("long").alias("chunk")).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("event_count"), F.sum("n_bytes").alias("n_bytes"), F.max("at").alias("last_at")
    )


def status(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """A3: head, number of chunks and last commit of each log."""
    return chunks(frames, size).groupBy("log").agg(F.max("last").alias("head_seq"), F.count(F.lit(1)).alias("n_chunks"), F.max("last_at").alias("last_at"))


def gaps(frames: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Places where a number doesn't follow its predecessor."""
    seen = preceding(frames.select("log", "seq"), "log", ["seq"], F.floor(F.col("seq") / width), {"before": "seq"})
    return seen.where(F.coalesce(F.col("before"), F.lit(0)) + 1 != F.col("seq")).select("log", F.coalesce("before", F.lit(0)).alias("after_seq"), "seq")


def trim(frames: DataFrame, before: Column) -> DataFrame:
    """M6: the floor never falls and never passes the head; frames above it survive."""
    head = frames.groupBy("log").agg(F.max("seq").alias("head_seq"))
    floor = head.withColumn("floor", F.greatest(F.lit(0), F.least(before, F.col("head_seq"))))
    return frames.join(floor, "log").groupBy("log").agg(F.max("floor").alias("floor"), F.count_if(F.col("seq") > F.col("floor")).alias("surviving"), (F.max("floor") + 1).alias("resume_at"))
