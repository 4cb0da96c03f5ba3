import pytest
from pyspark.sql import functions as F

from weirflow.plans.feeds import Feeds
from weirflow.sources.commitlog import LocalStore
from weirflow.streaming import follow


def test_stream_to_feed_and_back(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "feeds")
    spark.range(40).select("id", F.concat(F.lit("p"), "id").cast("binary").alias("payload")).repartition(3).write.parquet(str(source))
    feeds = Feeds(spark, root, LocalStore(root))
    stream = spark.readStream.schema("id long, payload binary").option("maxFilesPerTrigger", "1").parquet(str(source))
    query = follow.commit_stream(stream, feeds, "log", "w", str(tmp_path / "ck"), "id")
    query.awaitTermination()
    assert feeds.ref("log").head_seq == 40
    # a second run has nothing new, and a replayed batch changes nothing
    follow.commit_stream(stream, feeds, "log", "w", str(tmp_path / "ck"), "id").awaitTermination()
    assert feeds.ref("log").head_seq == 40
    got = []
    follow.run_once(follow.follow(spark, root, "log", 11), lambda df: got.extend(r.seq for r in df.collect()), str(tmp_path / "ck2"))
    assert sorted(got) == list(range(11, 41))


def test_commits_are_followed_on_any_file_system(spark, tmp_path):
    """Through Spark's own readers: once each, across compaction and renewals, from a start on; trimmed starts fail."""
    from weirflow.sources.commitlog import HadoopStore

    root = f"file://{tmp_path}/feeds"
    feeds = Feeds(spark, root, HadoopStore(spark, root))
    got = []

    def run():
        follow.follow_commits(spark, root, "log", lambda df, n: got.extend(r.seq for r in df.collect()), str(tmp_path / "ck"), 3).awaitTermination()

    rows = lambda n: spark.range(n).select(F.col("id").cast("string").cast("binary").alias("payload"), F.col("id").alias("_order"))
    for k in range(3):
        feeds.append("log", f"op{k}", "w", rows(4), f"r{k}", 600)
    run()
    assert sorted(got) == list(range(3, 13))
    feeds.renew("log", 1, 600)
    assert feeds.compact("log") == 3
    feeds.append("log", "op3", "w", rows(4), "r3", 600)
    run()
    assert sorted(got) == list(range(3, 17))
    compacted = []
    follow.run_once(follow.follow(spark, root, "log", 2), lambda df: compacted.extend(r.seq for r in df.collect()), str(tmp_path / "ck3"))
    assert sorted(compacted) == list(range(2, 17))
    feeds.trim_before("log", 5)
    with pytest.raises(Exception, match="resume at 6"):
        run()


def test_first_deliveries(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t timestamp").parquet(str(tmp_path / "in"))
    got = []
    follow.run_once(follow.first_deliveries(stream, "id", "t"), lambda df: got.extend(r.id for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(got) == [1, 2]
