"""Input tables, and tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard, handed_on, own_path, shared_dir, stage

__all__ = ["discard", "handed_on", "own_path", "shared_dir", "stage", "table"]

#: An input with fewer bytes a core than this may lie in fewer row groups than there are cores.
SMALL = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. One that is small for the cluster is dealt over all its cores, as its
    few row groups would else keep as many cores busy and no more; others are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
