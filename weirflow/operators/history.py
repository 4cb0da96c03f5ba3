"""Commits of a ref: history, order, links between generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feed import preceding


def newest(commits: DataFrame, ref: str, n: int) -> DataFrame:
    """The last ``n`` commits of each ref, newest first, each with the ref's live target too."""
    w = Window.partitionBy(ref).orderBy(F.desc("generation"))
    ranked = commits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.withColumn("live_target", F.first("target").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def regressions(states: DataFrame, ref: str, order: list[str], bucket: Column) -> DataFrame:
    """Observations in which generation or epoch fell; ``bucket`` as in ``feed.running``."""
    seen = preceding(states, ref, order, bucket, {"generation_before": "generation", "epoch_before": "epoch"})
    return seen.where((F.col("generation") < F.col("generation_before")) | (F.col("epoch") < F.col("epoch_before")))


def breaks(commits: DataFrame, ref: str, width: int = 1 << 16) -> DataFrame:
    """Commits whose parent isn't the generation before."""
    seen = preceding(commits, ref, ["generation"], F.floor(F.col("generation") / width), {"parent": "generation"})
    return seen.withColumn("parent", F.coalesce("parent", F.lit(0))).where(F.col("parent") + 1 != F.col("generation"))


def consistency(refs: DataFrame, commits: DataFrame, ref: str) -> DataFrame:
    """The live ref must agree with its last commit."""
    last = commits.groupBy(ref).agg(F.max(F.struct("generation", "epoch", "target")).alias("c"))
    both = refs.join(last, ref, "full")
    kind = F.when(F.col("c").isNull(), "no_commit").when(F.col("target").isNull() & F.col("generation").isNull(), "no_ref").when(F.col("generation") != F.col("c.generation"), "generation").when(F.col("epoch") != F.col("c.epoch"), "epoch").when(~F.col("target").eqNullSafe(F.col("c.target")), "target").otherwise("ok")
    return both.select(ref, kind.alias("finding"))


def skip_distance(generation: Column) -> Column:
    """The lowest set bit."""
    return generation.bitwiseAND(-generation)


def skip_target(generation: Column) -> Column:
    return F.when(generation == 0, F.lit(0).cast("long")).otherwise(generation - skip_distance(generation))


def at_generation(commits: DataFrame, generation: Column) -> DataFrame:
    """The commit of a generation; a filter instead of a walk along skip links."""
    return commits.where(F.col("generation") == generation)


def seek_time(frames: DataFrame, moment: Column) -> DataFrame:
    """X1 (specified, not part of the reference's code): the last number committed by a moment."""
    return frames.where(F.col("at") <= moment).groupBy("log").agg(F.max("seq").alias("seq"))
