import pytest
from pyspark.sql import functions as F

from weirflow import model as M
from weirflow.plans.config import Config
from weirflow.plans.feeds import Feeds
from weirflow.plans.session import LeasePolicy, Session
from weirflow.plans.sweep import sweep
from weirflow.sources.commitlog import FailpointStore, MemoryStore


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def make(store=None):
    return Feeds(None, "unused", store or MemoryStore(), Clock())


def test_policy():
    for bad in ({"renew": 26}, {"ttl": 601, "acquire": 700}, {"acquire": 29}, {"renew": 0}):
        with pytest.raises(M.InvalidRequest):
            LeasePolicy(**bad)


def test_session_life():
    feeds = make()
    a, b = Session(feeds, "l", "a"), Session(feeds, "l", "b")
    assert a.acquire() == 1 and a.active() == 1
    waits = []

    def wait(s):
        waits.append(s)
        feeds.clock.now += 10

    assert b.acquire(wait) == 2 and len(waits) == 3  # until a's lease has ended
    with pytest.raises(M.LeaseExpired):
        a.active()
    assert (a.state, a.reason) == ("lost", "fenced")
    with pytest.raises(M.Rejected):
        a.acquire()
    b.renew()
    assert b.active() == 2
    feeds.clock.now += 26
    with pytest.raises(M.LeaseExpired):  # within the slack
        b.active()
    b.close()
    c = Session(feeds, "l", "c")
    feeds.clock.now += 10
    c.acquire()
    c.close()
    assert feeds.ref("l").holder is None and c.state == "closed"


def test_waiting_ends():
    feeds = make()
    Session(feeds, "l", "a", LeasePolicy(ttl=600, acquire=600)).acquire()

    def wait(s):
        feeds.clock.now += 20

    with pytest.raises(M.LeaseHeld):
        Session(feeds, "l", "b").acquire(wait)


def test_an_unavailable_store_loses_no_session():
    store = FailpointStore(MemoryStore(), "put_create", part="refs/", times=0)
    feeds = make(store)
    a = Session(feeds, "l", "a")
    a.acquire()
    store.times = 100
    a.renew()
    assert a.state == "active"
    store.times = 0
    feeds.steal("l", "b", 30)
    a.renew()
    assert (a.state, a.reason) == ("lost", "fenced")


def test_config(tmp_path, spark):
    c = Config("t1", f"file://{tmp_path}/data", digest_key="secret")
    c.save(tmp_path / "c.json")
    assert Config.load(tmp_path / "c.json") == c
    assert "secret" not in repr(c)
    with pytest.raises(M.AlreadyExists):
        c.save(tmp_path / "c.json")
    with pytest.raises(M.InvalidRequest):
        Config("a/b", "x")
    c.store(spark).put_create("k", b"v")
    assert (tmp_path / "data" / "t1" / "k").read_bytes() == b"v"


def test_sweep(spark):
    d = [f"hs2:{i:064x}" for i in range(6)]
    objects = spark.createDataFrame([(d[0], f'{{"next": "{d[1]}"}}', "2024-01-01"), (d[1], "{}", "2024-01-01"), (d[2], "{}", "2024-01-01"), (d[3], "{}", "2024-02-01"), (d[4], f'"see {d[2]}"', "2024-01-01")], "digest string, body string, modified string")
    objects = objects.withColumn("modified", F.to_timestamp("modified"))
    refs = spark.createDataFrame([(f'{{"target": "{d[0]}", "lost": "{d[5]}"}}',)], "body string")
    now = F.lit("2024-02-02").cast("timestamp")
    report, found = sweep(refs, objects, now, 7)
    assert report.first().asDict() == {"refs_scanned": 1, "objects_scanned": 5, "reachable": 3, "in_grace": 1, "candidates": 2, "deleted": 0}
    assert sorted(r.node for r in found.collect()) == [d[2], d[4]]
    with pytest.raises(M.Rejected):
        sweep(refs, objects, now, 7, delete=True)
