import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from weirflow import model as M
from weirflow.functions import checks, identity
from weirflow.operators import folds, history, holdings, measure
from weirflow.sources import blobs, bridge


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_hmac_matches_the_library(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        got = one(spark, identity.hmac_sha256(key, F.lit("text é").cast("binary")))[0]
        assert got == hmac.new(key, "text é".encode(), hashlib.sha256).hexdigest()


def test_crockford_round_trip(spark):
    digits = "0123456789abcdef" * 3
    encoded = one(spark, identity.crockford_encode(F.lit(digits), 192))[0]
    n, text = int(digits, 16), ""
    for _ in range(39):
        text, n = identity.CROCKFORD[n & 31] + text, n >> 5
    assert encoded == text
    back = one(spark, identity.crockford_decode(F.lit(encoded), 192), identity.crockford_decode(F.lower(F.lit(encoded.replace("1", "l").replace("0", "O"))), 192), identity.crockford_decode(F.lit("U" * 39), 192))
    assert back == (digits, digits, None)


def test_operation_ids(spark):
    op = identity.operation_id(F.lit(1_700_000_000_123), F.lit("ab" * 18))
    text, millis, kind = one(spark, op, identity.issued_at_millis(op), identity.identity_kind(op))
    assert len(text) == 42 and millis == 1_700_000_000_123 and kind == "operation"
    assert one(spark, identity.identity_kind(F.lit("sk_0a")), identity.identity_kind(F.lit("sk_0")), identity.identity_kind(F.lit("x"))) == ("stable", None, None)


def test_decimals_and_overflow(spark):
    got = one(spark, *(identity.decimal_u64(F.lit(x)) for x in ("0", "10", "01", "-1", "", "18446744073709551615", "18446744073709551616")))
    assert got == (0, 10, None, None, None, 2**64 - 1, None)


def test_validators(spark):
    names = one(spark, *(checks.valid_log_name(F.lit(x)) for x in ("a", "a.b-c_1", "a..b", ".a", "a/b", "a" * 128, "a" * 129, "")))
    assert names == (True, True, False, False, False, True, False, False)
    gate = lambda s, used: checks.time_gate(F.lit(s).cast("timestamp"), F.lit("2024-01-08 00:00:00").cast("timestamp"), F.lit(used))
    assert one(spark, gate("2024-01-08 00:02:00", False), gate("2024-01-08 00:02:01", False), gate("2024-01-07 23:55:00", False), gate("2024-01-07 23:54:59", False), gate("2024-01-07 23:54:59", True), gate("2024-01-01 00:00:00", True)) == ("ok", "invalid", "ok", "unknown", "ok", "unknown")


def test_skip_links(spark):
    got = one(spark, *(history.skip_distance(F.lit(g)) for g in (0, 1, 2, 3, 8, 12)), history.skip_target(F.lit(12)))
    assert got == (0, 1, 2, 1, 8, 4, 8)


def test_group_commit_may_overshoot(spark):
    rows = spark.createDataFrame([("a", 0, 1, 5), ("a", 1, 2, 5), ("a", 2, 3, 5), ("a", 200, 4, 1)], "log string, at_us long, event_id long, n long")
    got = {r.event_id: r.batch for r in folds.group_commits(rows, 100, 8).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}


def test_ranks_of_skewed_values(spark):
    """Ties, nulls, a key with one value, a key without any; against sorting."""
    import math
    import random

    rng = random.Random(3)
    values = [("a", rng.choice([None, -1.5, 0.0, rng.random(), rng.random() ** 9])) for _ in range(500)] + [("b", 7.0), ("c", None)]
    df = spark.createDataFrame(values, "k string, v double")
    real = {k: sorted(v for x, v in values if x == k and v is not None) for k in "ab"}
    for got, at in ((measure.lower_ranks(df, "k", "v", {"p": 0.5, "q": 0.99}), lambda n, p: math.floor((n - 1) * p)), (measure.upper_ranks(df, "k", "v", {"p": 0.5, "q": 0.99}), lambda n, p: math.ceil(n * p) - 1)):
        assert {r.k: (r.n, r.p, r.q) for r in got.collect()} == {k: (len(v), v[at(len(v), 0.5)], v[at(len(v), 0.99)]) for k, v in real.items()}
    assert measure.lower_ranks(df.limit(0), "k", "v", {"p": 0.5}).collect() == []


def test_key_paths_and_texts(spark):
    key = b"k"
    a, b, text, back = one(spark, identity.stable_path(key, F.lit(bytearray(b"x"))), identity.stable_path(key, F.lit(bytearray(b"y"))), identity.stable_key_text(F.lit(bytearray(b"\x01\xff"))), identity.parse_stable_key(F.lit("sk_01ff")))
    assert a != b and a.startswith("hs2:") and text == "sk_01ff" and bytes(back) == b"\x01\xff"
    assert 0 <= one(spark, identity.partition_of(F.lit(5), 16))[0] < 16


def test_files_as_objects(spark, tmp_path):
    """Put, get by digest, verify; a cap refuses before contents are read."""
    (tmp_path / "in").mkdir()
    for n, body in (("a", b"one"), ("b", b"three"), ("c", b"one")):
        (tmp_path / "in" / n).write_bytes(body)
    files = blobs.import_files(spark, str(tmp_path / "in"), 5)
    objects = files.select(identity.keyed_digest(b"k", F.col("payload")).alias("digest"), "plaintext_bytes", "payload").dropDuplicates(["digest"])
    blobs.write(objects, str(tmp_path / "objects"))
    back = spark.read.parquet(str(tmp_path / "objects"))
    wanted = objects.where("plaintext_bytes = 5").first().digest
    assert [bytes(r.payload) for r in blobs.get(back, wanted).collect()] == [b"three"]
    assert back.count() == 2 and {r.verdict for r in blobs.verify(back, b"k").collect()} == {"ok"}
    with pytest.raises(M.ObjectTooLarge):
        blobs.import_files(spark, str(tmp_path / "in"), 4)


def test_names_and_forks(spark):
    refs = spark.createDataFrame([("a", "b", None), ("b", None, "t"), ("c", "gone", None), ("x", "y", None), ("y", "x", None)], "ref string, symbol string, target string")
    got = {r.ref: (r.target, r.hops, r.status) for r in holdings.resolve(refs).collect()}
    assert got == {"a": ("t", 1, "ok"), "b": ("t", 0, "ok"), "c": (None, 1, "dangling"), "x": (None, 4, "too_deep"), "y": (None, 4, "too_deep")}
    writes = spark.createDataFrame([(0, 1, 1, "a"), (0, 2, 2, "b"), (0, 1, 3, "c"), (1, 2, 4, None), (1, 3, 5, "d")], "volume int, block int, seq int, data string")
    parent = holdings.blocks_at(writes.where("volume = 0"), F.lit(2))
    assert sorted((r.block, r.data) for r in holdings.forked(parent, holdings.blocks_at(writes.where("volume = 1"), F.lit(9))).collect()) == [(1, "a"), (2, None), (3, "d")]


def test_rank_rules_differ(spark):
    df = spark.createDataFrame([("k", v) for v in range(1, 101)], "k string, v long")
    assert measure.lower_ranks(df, "k", "v", {"p": 0.99}).first().p == 99
    assert measure.upper_ranks(df, "k", "v", {"p": 0.991}).first().p == 100


def test_objects(spark, tmp_path):
    key = b"k"
    rows = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"bb")], "id long, payload binary")
    stored = blobs.put(rows, key, "payload", "id")
    assert sorted((r.first_id, r.copies, r.n_bytes) for r in stored.collect()) == [(1, 2, 1), (3, 1, 2)]
    assert blobs.new_only(stored, stored.where("first_id = 1")).count() == 1
    objects = rows.dropDuplicates(["payload"]).select(identity.keyed_digest(key, F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("plaintext_bytes"), "payload")
    blobs.write(objects, str(tmp_path / "objects"))
    back = spark.read.parquet(str(tmp_path / "objects"))
    assert {r.verdict for r in blobs.verify(back, key).collect()} == {"ok"}
    assert {r.verdict for r in blobs.verify(back, key, 1).collect()} == {"ok", "too_large"}


def test_protocol(spark, tmp_path):
    (tmp_path / "in").write_bytes(b'{"v":1,"id":"a","op":"head","log":"x"}\r\n{"id":"b",\nnot json\n{"v":1,"id":"c","op":"follow","log":"x","cursor":"1","timeout_ms":30001}\n{"v":2,"id":"d","op":"head","log":"x"}\n')
    got = [(r.id, r.op, r.status) for r in bridge.parse(bridge.read_lines(spark, str(tmp_path / "in"))).collect()]
    assert got == [("a", "head", "ok"), ("b", None, "invalid_json"), (None, None, "invalid_json"), ("c", "follow", "invalid_request"), ("d", "head", "invalid_request")]
    page = spark.createDataFrame([("r", "x", 2, "2024-01-01 00:00:00", "b"), ("r", "x", 1, "2024-01-01 00:00:00", "a")], "id string, log string, seq long, at string, payload string")
    line = bridge.respond(page.withColumn("at", F.col("at").cast("timestamp"))).first().line
    assert '"next_cursor":"3"' in line and line.index('"seq":"1"') < line.index('"seq":"2"')
