"""Reachability over stored objects: a report, and never a deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Rejected
from ..operators import reach


def sweep(refs: DataFrame, objects: DataFrame, now: Column, grace_days: int, delete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Roots are the digests in ``refs`` (body), edges those in ``objects`` (digest,
    body, modified). Returns the report and the candidates. Asking for deletion is refused."""
    if delete:
        raise Rejected("a sweep deletes nothing")
    roots = reach.digest_edges(refs.withColumn("_ref", F.lit("ref")), "_ref", "body").select(F.col("dst").alias("node"))
    reached = reach.reachable(roots, reach.digest_edges(objects, "digest", "body"))
    stored = objects.select(F.col("digest").alias("node"), "modified")
    return reach.report(stored, reached, refs.count(), now, grace_days), reach.candidates(stored, reached, now, grace_days)
