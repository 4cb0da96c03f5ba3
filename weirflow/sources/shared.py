"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, tuple[str, ...]] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a folder of this process, in local mode only: elsewhere each executor
    would write to a disk of its own, so that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="weirflow-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else has."""
    return f"{shared_dir(spark)}/weirflow-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read from there.

    A lost executor then costs a read, not the work above; every later use sees the same
    rows, also where they came from an expression that differs between runs.
    """
    path, schema = own_path(df.sparkSession, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    _PATHS[out] = (path,)
    return out


def handed_on(df: DataFrame, *staged: DataFrame) -> DataFrame:
    """``df``, which reads what ``staged`` do and takes over their files."""
    paths = [p for s in staged for p in _PATHS.pop(s, ())]
    _PATHS[df] = (*_PATHS.get(df, ()), *paths)
    return df


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; other DataFrames are left alone."""
    for df in staged:
        for path in _PATHS.pop(df, ()):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
