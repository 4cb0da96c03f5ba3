"""What a store holds: names, releases, trees, volumes, retention, accounting and checks.

These are specified beside the reference's code rather than part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbolic names that may be followed for one look-up.
DEPTH = 4


def by_id(frames: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The number of each wanted event, null if the feed lacks it."""
    return wanted.join(frames.select(*on, "seq"), on, "left")


def resolve(refs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The target behind each name (ref, symbol, target), over at most ``depth`` symbolic names.

    A symbol names another ref, a target ends the chain. Every hop is an equi-join of the names
    that are still on their way; longer chains, cycles included, are too deep.
    """
    known = refs.select(F.col("ref").alias("_ref"), F.col("symbol").alias("_symbol"), F.col("target").alias("_target"))
    now = refs.select("ref", F.col("symbol").alias("at"), "target", F.lit(0).alias("hops"), F.lit(True).alias("there"))
    for _ in range(depth):
        going = F.col("at").isNotNull() & F.col("there")
        met = now.join(known, F.col("at") == F.col("_ref"), "left")
        now = met.select("ref", F.when(going, F.col("_symbol")).otherwise(F.col("at")).alias("at"), F.when(going, F.col("_target")).otherwise(F.col("target")).alias("target"), (F.col("hops") + going.cast("int")).alias("hops"), (F.col("there") & (~going | F.col("_ref").isNotNull())).alias("there"))
    status = F.when(~F.col("there"), "dangling").when(F.col("at").isNotNull(), "too_deep").otherwise("ok")
    return now.select("ref", F.when(status == "ok", F.col("target")).alias("target"), "hops", status.alias("status"))


def release(commits: DataFrame, ref: str, at: Column) -> DataFrame:
    """A consistent cut, the last commit of each ref up to a moment."""
    return commits.where(F.col("ts") <= at).groupBy(ref).agg(F.max_by(F.struct("generation", "target"), "generation").alias("c")).select(ref, "c.*")


def live_roots(roots: DataFrame, pins: DataFrame, now: Column) -> DataFrame:
    """The roots and the pins (node, expires) that haven't expired; a pin without an end never does."""
    return roots.select("node").union(pins.where(F.col("expires").isNull() | (F.col("expires") > now)).select("node")).distinct()


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths (path, digest) that differ between two trees."""
    both = old.select("path", F.col("digest").alias("a")).join(new.select("path", F.col("digest").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def lag(heads: DataFrame, cursors: DataFrame, on: str) -> DataFrame:
    """How many events each reader is behind; a reader that has read nothing is behind by all."""
    return heads.join(cursors, on, "left").withColumn("lag", F.col("head_seq") - F.coalesce(F.col("cursor") - 1, F.lit(0)))


def accounting(blobs: DataFrame, kept: Column) -> DataFrame:
    """Bytes as written, as stored once each, and as something still needs (digest, n_bytes)."""
    each = blobs.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n_bytes").alias("logical"), F.max(kept).alias("kept"))
    return each.agg(F.sum("logical").alias("logical_bytes"), F.sum("n_bytes").alias("unique_bytes"), F.sum(F.when(F.col("kept"), F.col("n_bytes")).otherwise(0)).alias("retained_bytes"), F.count(F.lit(1)).alias("objects"))


def fsck(edges: DataFrame, objects: DataFrame, reached: DataFrame) -> DataFrame:
    """X11: nodes with what is wrong: missing though reached, corrupt (ok is false), or an orphan."""
    both = objects.select("node", "ok").join(reached.select("node", F.lit(True).alias("needed")).distinct(), "node", "full")
    targets = edges.select(F.col("dst").alias("node"), F.lit(True).alias("target")).distinct()
    both = both.join(targets, "node", "left")
    finding = F.when(F.col("ok").isNull() & F.col("target"), "missing").when(~F.col("ok"), "corrupt").when(F.col("needed").isNull(), "orphan")
    return both.select("node", finding.alias("finding")).where("finding IS NOT NULL")


def blocks_at(writes: DataFrame, upto: Column) -> DataFrame:
    """The block map of each volume at a checkpoint: the last write of each block up to it."""
    return writes.where(F.col("seq") <= upto).groupBy("volume", "block").agg(F.max_by("data", "seq").alias("data"), F.max("seq").alias("seq"))


def forked(parent: DataFrame, own: DataFrame) -> DataFrame:
    """A fork's map: its own blocks, else those of its parent at the fork's checkpoint."""
    mine = own.select("block", F.col("data").alias("_own"), F.lit(True).alias("_there"))
    return parent.select("block", "data").join(mine, "block", "full").select("block", F.when(F.col("_there"), F.col("_own")).otherwise(F.col("data")).alias("data"))


def retained(commits: DataFrame, ref: str, now: Column, days: int, last: int, hold: Column) -> DataFrame:
    """Whether each commit is kept, and by which rule: held, among the last ones, or recent.

    The last commits of a ref follow from its newest generation, as generations are dense.
    """
    newest = commits.groupBy(ref).agg(F.max("generation").alias("_newest"))
    recent = F.col("ts") > now - F.make_dt_interval(F.lit(days))
    rule = F.when(hold, "hold").when(F.col("generation") > F.col("_newest") - last, "last").when(recent, "recent").otherwise("expired")
    return commits.join(newest, ref).withColumn("rule", rule).drop("_newest")


def audit(operations: DataFrame, who: str, what: str, at: str) -> DataFrame:
    """Who did what and when, of operations that were carried out."""
    return operations.where("status = 'ok'").select(F.col(who).alias("actor"), F.concat(F.lit("ref."), F.col(what)).alias("action"), F.col(at).alias("at_us"), "ref", "event_id", "generation")
