"""Bounded pages of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_pages(frames: DataFrame, cursors: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """The frames of one page for each cursor (log, cursor, head_seq, trim).

    The page is the longest run from the cursor that stays within both budgets. Numbers are
    dense, so at most ``max_events`` frames of a log can be in it and the running sum covers
    no more than those.
    """
    inside = cursors.select("log", "cursor", "trim").join(frames, "log").where(F.col("seq").between(F.col("cursor"), F.col("cursor") + max_events - 1) & (F.col("seq") > F.col("trim")))
    upto = F.sum("n_bytes").over(Window.partitionBy("log").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto).where(F.col("upto") <= max_bytes)


def page_summary(frames: DataFrame, cursors: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """What a page holds and where the next begins, or why there is none.

    A cursor of 0 or beyond the next number is invalid, one at or below the floor is trimmed,
    and a first frame beyond the byte budget is too large and leaves the cursor where it is.
    """
    page = read_pages(frames, cursors, max_events, max_bytes).groupBy("log").agg(F.count(F.lit(1)).alias("n_events"), F.sum("n_bytes").alias("n_bytes"))
    both = cursors.join(page, "log", "left").withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "n_bytes": F.coalesce("n_bytes", F.lit(0))})
    status = (
        F.when((F.col("cursor") < 1) | (F.col("cursor") > F.col("head_seq") + 1), "invalid_cursor").when(F.col("cursor") <= F.col("trim"), "trimmed").when((F.col("n_events") == 0) & (F.col("cursor") <= F.col("head_seq")), "event_too_large").otherwise("ok")
    )
    out = both.withColumn("status", status).withColumn("next_seq", F.col("cursor") + F.col("n_events"))
    at_head = (F.col("status") == "ok") & (F.col("next_seq") == F.col("head_seq") + 1)
    return out.withColumn("at_head", at_head).withColumn("timed_out", at_head & (F.col("n_events") == 0))
