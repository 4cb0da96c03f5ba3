"""Objects reachable from roots, and what a sweep would take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, stage


def digest_edges(objects: DataFrame, id_col: str, body: str) -> DataFrame:
    """Digests that are whole JSON string values anywhere in an object's body.

    Escaped pairs, which only stand inside strings, are blanked first, so that every quote left
    begins or ends a string; a string before a colon is a key and no value.
    """
    plain = F.regexp_replace(F.col(body), r"(?s)\\.", "\ufffd")
    strings = F.regexp_extract_all(plain, F.lit(r'"[^"]*+"\s*+:?'), F.lit(0))
    values = F.transform(F.filter(strings, lambda s: s.rlike(r'^"[a-z0-9]+:[0-9a-f]{64}"\s*$')), lambda s: F.split(s, '"')[1])
    return objects.select(F.col(id_col).alias("src"), F.explode(values).alias("dst")).distinct()


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: all nodes reachable from ``roots`` (node) along ``edges`` (src, dst), with the number of steps.

    Edges are written once, without those that lead back to their own source. A round joins the
    frontier with the edges, marks what is new against the nodes seen, and both are tables in
    the shared folder, so a lost executor repeats one round, and the plan stays short. Rounds
    are as many as the longest shortest path; targets that no object has are counted as well.
    """
    links = stage(edges.where("src <> dst").select("src", "dst"), "edges")
    seen = [stage(roots.select("node").distinct().withColumn("depth", F.lit(0)), "reach")]
    while True:
        front = seen[-1].select(F.col("node").alias("src"))
        ahead = links.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        known = seen[0].select("node")
        for s in seen[1:]:
            known = known.union(s.select("node"))
        new = stage(ahead.join(known, "node", "left_anti").withColumn("depth", F.lit(len(seen))), "reach")
        if new.isEmpty():
            discard(new, links)
            out = seen[0]
            for s in seen[1:]:
                out = out.union(s)
            return out
        seen.append(new)


def candidates(objects: DataFrame, reached: DataFrame, now: Column, grace_days: int) -> DataFrame:
    """Objects (node, modified) that nothing reaches and that are older than the grace period."""
    return objects.join(reached.select("node"), "node", "left_anti").where(F.col("modified") <= now - F.make_dt_interval(F.lit(grace_days)))


def first_names(found: DataFrame, n: int = 20) -> DataFrame:
    """The first names for display, and how many more there are."""
    total = found.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more")).withColumn("_k", F.lit(1))
    return found.select("node").orderBy("node").limit(n).withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")


def report(objects: DataFrame, reached: DataFrame, roots: int, now: Column, grace_days: int) -> DataFrame:
    """A10: the figures of a dry run; nothing is ever deleted."""
    marked = objects.join(reached.select("node", F.lit(True).alias("_r")).distinct(), "node", "left")
    free = F.col("_r").isNull()
    old = F.col("modified") <= now - F.make_dt_interval(F.lit(grace_days))
    n = reached.agg(F.count(F.lit(1)).alias("reachable"))
    figures = marked.agg(F.count(F.lit(1)).alias("objects_scanned"), F.count_if(free & ~old).alias("in_grace"), F.count_if(free & old).alias("candidates"))
    return figures.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").select(F.lit(roots).cast("long").alias("refs_scanned"), "objects_scanned", "reachable", "in_grace", "candidates", F.lit(0).cast("long").alias("deleted"))
