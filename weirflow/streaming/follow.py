"""Following feeds, and committing streams to them, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..model import FRAME, Trimmed
from ..plans.feeds import ORDER, Feeds
from ..sources.commitlog import LocalStore


class _Files(InputPartition):
    def __init__(self, path: str, group: int, first: int, last: int):
        self.path, self.group, self.first, self.last = path, group, first, last


class _Reader(DataSourceStreamReader):
    """The offset is the next number to read, so lease renewals wake nobody."""

    def __init__(self, options: dict):
        self.root, self.log, self.start = options["path"], options["log"], int(options.get("startingseq", "1"))
        self.control = options.get("control", self.root)

    def _feeds(self) -> Feeds:
        return Feeds(None, self.root, LocalStore(self.control.removeprefix("file://")))

    def initialOffset(self) -> dict:
        return {"next_seq": self.start}

    def latestOffset(self) -> dict:
        return {"next_seq": max(self._feeds().ref(self.log).next_seq, self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A slice for each row group, so a compacted log is read by as many tasks."""
        import pyarrow.dataset as ds

        feeds = self._feeds()
        at, first, last = feeds.ref(self.log), start["next_seq"], end["next_seq"] - 1
        if at.trim and first <= at.trim and first <= last:
            raise Trimmed(at.trim + 1)  # T8: never a silent gap
        out: list[InputPartition] = []
        for f in feeds.files(at):
            if f["last"] >= first and f["first"] <= last:
                for fragment in ds.dataset(f["path"].removeprefix("file://"), format="parquet", exclude_invalid_files=True).get_fragments():
                    out += [_Files(fragment.path, g.id, first, last) for g in fragment.row_groups]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        schema = pa.schema([("seq", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("payload", pa.binary())])
        for b in pq.ParquetFile(partition.path).iter_batches(batch_size=8192, row_groups=[partition.group], columns=["seq", "at", "payload"]):
            keep = pc.and_(pc.greater_equal(b.column(0), partition.first), pc.less_equal(b.column(0), partition.last))
            yield from pa.Table.from_batches([b]).filter(keep).cast(schema).to_batches()


class FeedSource(DataSource):
    """``spark.readStream.format("weirflow").option("path", root).option("log", name)``."""

    @classmethod
    def name(cls) -> str:
        return "weirflow"

    def schema(self) -> str:
        return "seq long, at timestamp, payload binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def follow(spark: SparkSession, root: str, log: str, start: int = 1, control: str | None = None) -> DataFrame:
    """A feed on a file system that all machines have mounted, as a streaming DataFrame."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("weirflow").option("path", root).option("log", log).option("startingSeq", str(start)).option("control", control or root).load()


#: What a reader needs of a revision's file.
REVISION = "kind string, trim long, adds array<struct<path:string,first:long,last:long,kind:string>>"


def follow_commits(spark: SparkSession, control: str, log: str, sink: Callable[[DataFrame, int], None], checkpoint: str, start: int = 1, available_now: bool = True) -> StreamingQuery:
    """The same on any file system that Spark reads.

    The stream is that of the log's revisions, which are files that are created once and whole;
    frames are read by Spark from the files that new commits name, in as many slices as it
    makes of them. ``sink`` gets seq, at and payload, and the batch's number. Compaction and
    renewals bring no frames and call no sink; a start at or below the floor is an error.
    """
    revisions = spark.readStream.schema(REVISION).option("pathGlobFilter", "*.json").json(f"{control}/refs/{log.replace('/', '%2F')}")

    def put(batch: DataFrame, number: int) -> None:
        told = batch.agg(F.max("trim").alias("trim")).first().trim or 0
        if told >= start:
            raise Trimmed(told + 1)
        # a row for each commit of the batch
        new = batch.where("kind IN ('append', 'stable')").select(F.explode("adds").alias("f")).where(F.col("f.last") >= start).select("f.path").collect()
        if new:
            frames = spark.read.schema(FRAME).parquet(*(r.path for r in new))
            sink(frames.where(F.col("seq") >= start).select("seq", "at", "payload"), number)

    writer = revisions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def commit_stream(stream: DataFrame, feeds: Feeds, log: str, writer: str, checkpoint: str, order: str, ttl: float = 600.0) -> StreamingQuery:
    """Each micro-batch is one commit. Its identity is the query's and the batch's, so
    a batch that is replayed after a failure gets its first receipt and appends nothing."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("payload").cast("binary").alias("payload"), F.col(order).alias(ORDER))
        if not rows.isEmpty():
            feeds.append(log, f"{checkpoint}#{number}", writer, rows, f"batch {number}", ttl, limit=0)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_deliveries(stream: DataFrame, identity: str, at: str, horizon: str = "7 days") -> DataFrame:
    """The first row of each identity within the horizon; later ones and late ones are dropped."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([identity])


def group_commit(stream: DataFrame, key: str, window_us: int, max_events: int) -> DataFrame:
    """Batches of submissions (at_us, event_id, n) as they arrive in order, with the open
    batch of each key kept as state between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, opened, held = state.get if state.exists else (0, 0, 0)
        # the sort needs a key's whole micro-batch, which maxFilesPerTrigger bounds; three numbers a row
        rows = pd.concat([b[["at_us", "event_id", "n"]] for b in batches]).sort_values(["at_us", "event_id"])
        numbers = []
        for at, n in zip(rows["at_us"], rows["n"], strict=True):
            if batch == 0 or at >= opened + window_us or held >= max_events:
                batch, opened, held = batch + 1, int(at), 0
            held += int(n)
            numbers.append(batch)
        state.update((batch, opened, held))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "batch": numbers})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, event_id long, batch long", "batch long, opened long, held long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str) -> None:
    """All that is there now, batch by batch, then ends."""
    query = stream.writeStream.foreachBatch(lambda df, _: sink(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
