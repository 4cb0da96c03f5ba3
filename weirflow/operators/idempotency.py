"""Keyed de-duplication, key lookup and acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feed import running


def group_dedup(submissions: DataFrame, batch: list[str], identity: str, order: list[str], payload: str = "payload") -> DataFrame:
    """Within a batch the first submission of an identity commits; equal ones share its
    acknowledgement and different ones conflict."""
    w = Window.partitionBy(*batch, identity).orderBy(*order)
    first = F.first(payload).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return submissions.withColumn("status", F.when(F.row_number().over(w) == 1, "first").when(first == F.col(payload), "shared").otherwise("conflict"))


def receipts(requests: DataFrame, key: str, log: str, order: list[str], bucket: Column, payload: str = "payload") -> DataFrame:
    """Idempotent appends over all history. The first request of a key commits and gets the
    log's next number; a later one with the same payload gets the original's number again, one
    with another payload is a conflict and gets none."""
    w = Window.partitionBy(log, key).orderBy(*order)
    marked = requests.withColumn("_nth", F.row_number().over(w))
    # numbering needs the first requests only; the rest look theirs up
    firsts = running(marked.where("_nth = 1"), log, order, bucket, F.lit(1), "seq").select(F.col(log), F.col(key), "seq", F.col(payload).alias("_first"))
    joined = marked.join(firsts, [log, key])
    same = F.col("_first") == F.col(payload)
    return joined.withColumn("status", F.when(F.col("_nth") == 1, "committed").when(same, "retry").otherwise("conflict")).withColumn("seq", F.when((F.col("_nth") == 1) | same, F.col("seq"))).drop("_nth", "_first")


def lookup(committed: DataFrame, probes: DataFrame, on: list[str]) -> DataFrame:
    """Exact lookup of keys; which side is small is for the optimiser to see."""
    return probes.join(committed, on, "left")


def acknowledgements(submissions: DataFrame, admissions: DataFrame, on: list[str]) -> DataFrame:
    """Each producer's own admission; without one it is a conflict."""
    return submissions.join(admissions.withColumn("_ack", F.lit(True)), on, "left").withColumn("acked", F.coalesce("_ack", F.lit(False))).drop("_ack")


def recover(requests: DataFrame, admissions: DataFrame, identity: str = "identity") -> DataFrame:
    """The commit that admitted an operation; another request under the same identity is a conflict."""
    found = requests.join(admissions.withColumnsRenamed({"request": "committed"}), identity, "left")
    return found.withColumn("outcome", F.when(F.col("committed").isNull(), "unknown").when(F.col("committed") == F.col("request"), "recovered").otherwise("conflict")).drop("committed")


def cached(cache: DataFrame, commits: DataFrame, ref: str) -> DataFrame:
    """Cached results (ref, generation, digest) that the canonical commit of that generation
    bears out; any other falls through to ``recover``."""
    real = commits.select(ref, "generation", F.col("digest").alias("_digest"))
    found = cache.join(real, [ref, "generation"], "left")
    return found.withColumn("valid", F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))).drop("_digest")


def entry_count(entries: DataFrame, log: str, key: str) -> DataFrame:
    """How many keys each log has ever admitted. Keys are made distinct first, so no task holds a log's keys."""
    return entries.select(log, key).distinct().groupBy(log).agg(F.count(F.lit(1)).alias("n_entries"))
