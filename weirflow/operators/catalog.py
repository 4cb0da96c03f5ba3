"""The chunk catalogue: intervals of numbers, their tree, and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CATALOG_FANOUT


def seek(catalog: DataFrame, probes: DataFrame, width: int = 64) -> DataFrame:
    """The chunk that covers each probe (log, seq), null outside. An interval is put under
    every ``width`` numbers that it touches, so a probe meets it by equality."""
    spread = catalog.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    asked = probes.withColumn("_cell", F.floor(F.col("seq") / width))
    near = (F.col("p.log") == F.col("c.log")) & (F.col("p._cell") == F.col("c._cell")) & F.col("p.seq").between(F.col("c.first"), F.col("c.last"))
    return asked.alias("p").join(spread.alias("c"), near, "left").select("p.*", "c.chunk", "c.first", "c.last").drop("_cell")


def contiguity(catalog: DataFrame) -> DataFrame:
    """Whether each chunk begins right after its predecessor, the first one at 1."""
    before = F.lag("last").over(Window.partitionBy("log").orderBy("first"))
    return catalog.withColumn("expected", F.coalesce(before, F.lit(0)) + 1).withColumn("contiguous", F.col("expected") == F.col("first"))


def levels(catalog: DataFrame, fanout: int = CATALOG_FANOUT, height: int = 3) -> DataFrame:
    """The nodes of the catalogue's tree: a parent spans its children and counts their chunks."""

    def level(k: int) -> DataFrame:
        node = F.floor(F.col("chunk") / fanout**k).cast("long")
        return catalog.groupBy("log", node.alias("node")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("chunk_count")).withColumn("level", F.lit(k))

    return reduce(DataFrame.unionByName, (level(k) for k in range(1, height + 1)))


def right_spine(tree: DataFrame) -> DataFrame:
    """The last node of each level, from which the next append goes on."""
    return tree.groupBy("log", "level").agg(F.max_by(F.struct("node", "first", "last", "chunk_count"), "node").alias("n")).select("log", "level", "n.*")


def integrity(stored: DataFrame, frames: DataFrame, chunk: int = 64) -> DataFrame:
    """Stored chunk figures against those of the frames."""
    from .feed import chunks

    real = chunks(frames, chunk).select("log", "chunk", F.col("first").alias("real_first"), F.col("last").alias("real_last"), F.col("event_count").alias("real_count"), F.col("n_bytes").alias("real_bytes"))
    both = stored.join(real, ["log", "chunk"], "full")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("first", "real_first"), ("last", "real_last"), ("event_count", "real_count"), ("n_bytes", "real_bytes"))]
    whole = (F.col("real_last") - F.col("real_first") + 1) == F.col("real_count")
    return both.withColumn("ok", F.coalesce(reduce(lambda a, b: a & b, same) & whole, F.lit(False))).select("log", "chunk", "ok")


def index_violations(entries: DataFrame, head_seq: int, head_generation: int) -> DataFrame:
    """What is wrong with an index entry (key, first, last, generation); right ones are left out."""
    wrong = (
        F.when(F.col("first") < 1, "first_below_one").when(F.col("last") < F.col("first"), "last_before_first").when((F.col("generation") < 1) | (F.col("generation") > head_generation), "generation_out_of_range").when(F.col("last") > head_seq, "beyond_head")
    )
    return entries.withColumn("violation", wrong).where("violation IS NOT NULL")
