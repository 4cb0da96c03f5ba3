"""Exact search against brute force; shards and their map; the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import catalogue, sharding, topk


def brute(rows, k=10, every=100):
    usable = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((n, i, [int(np.floor(1024 * float(x))) for x in v]))
    out = defaultdict(list)
    for n, i, v in usable:
        if i is not None and i % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, m) for m, j, w in usable if m != n and len(w) == len(v)))
            out[i].append([(r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(scores[:k])])
    return {i: sorted(x, key=repr) for i, x in out.items()}


def found(df, n_each):
    by = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    return by


@pytest.mark.parametrize("leaf", [64, 3])
def test_top_k_is_exact(spark, monkeypatch, leaf):
    monkeypatch.setattr(topk, "LEAF", leaf)
    monkeypatch.setattr(topk, "DATA_BLOCK", 150)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1000)]  # ties
    got = found(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(100)) == 0), 10)
    assert {i: [x] for i, x in got.items()} == brute(rows)


def test_nodes_are_left_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 1000
    x = (centres[np.arange(2000) % 20] + rng.normal(size=(2000, 16))).astype(np.int64)
    data = topk.build(x, np.arange(2000), np.arange(2000))
    queries = topk.build(x[:1000], np.arange(1000), np.arange(1000))
    best = topk.Best(queries, 5)
    assert topk.search(queries, data, best) < 1000 * 2000 / 2

    def covered(node):
        assert np.sqrt(((data.vectors[node.first : node.first + node.n] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        for c in node.children:
            covered(c)

    covered(data.root)
    assert sorted(data.ids.tolist()) == list(range(2000))


def test_top_k_odd_input(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0, -1.0]), (None, [9.0, 9.0]), (100, [1.0, 1.0, 1.0]), (200, [])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect()
    by = Counter(r.query_id for r in got)
    assert by == {0: 6}  # two queries of id 0, three candidates each; 100 and 200 have none of their length
    assert sorted((r["rank"], r.vec_id is None, r.score) for r in got) == sorted([(1, True, 27 << 20), (2, False, 5 << 20), (3, False, 1 << 20)] * 2)
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []
    big = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**30, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big, F.lit(True)).collect()
    large = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 3.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(large, F.col("vec_id") == 0).first().score == (1 << 60) + 3 * (1 << 20)


def test_shards(spark, docs):
    placed, owners = sharding.assign(docs, 16)
    rows = placed.collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(text) and len(rows) == len(text)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.shard == owners.owner[r.virtual_slot]
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)


def test_stored_map_is_edited(spark, docs, tmp_path):
    """The second run takes the first one's map on; a record's slot follows from the record alone."""
    path = str(tmp_path / "map")
    once, first = sharding.assign(docs, 16, map_path=path)
    again, second = sharding.assign(docs.unionByName(docs.limit(40)).repartition(7), 16, map_path=path)
    assert (first.version, second.version) == (2, 3)
    assert sharding.SlotMap.load(spark, path) == second and sharding.SlotMap.load(spark, path, 1).note == "even"
    slots = {r.doc_id: r.virtual_slot for r in once.collect()}
    by = defaultdict(list)
    for r in again.collect():
        by[r.doc_id].append(r.virtual_slot)
    assert all(slots[i] in found for i, found in by.items())
    assert sum(len(found) == 2 and len(set(found)) == 2 for found in by.values()) >= 38
    assert sum(a != b for a, b in zip(first.owner, second.owner, strict=True)) < sharding.SLOTS / 10


def test_map_versions(spark, tmp_path):
    sizes = [(i * 7919) % 1000 + 1 for i in range(4096)]
    first = sharding.SlotMap.even(4096, 16).rebalance(sizes)
    load = Counter()
    for s, o in zip(sizes, first.owner, strict=True):
        load[o] += s
    assert max(load.values()) - min(load.values()) <= 1000
    grown = first.grow(sizes)
    moved = [(a, b) for a, b in zip(first.owner, grown.owner, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {16} and grown.version == 3
    share = sum(s for s, o in zip(sizes, grown.owner, strict=True) if o == 16)
    assert abs(share - sum(sizes) / 17) < 0.02 * sum(sizes) / 17
    skewed = [s * (3 if o == 0 else 1) for s, o in zip(sizes, grown.owner, strict=True)]
    again = grown.rebalance(skewed)
    load = Counter()
    for s, o in zip(skewed, again.owner, strict=True):
        load[o] += s
    assert again.version == 4 and max(load.values()) - min(load.values()) < 2000
    for m in (first, grown, again):
        m.save(spark, str(tmp_path / "map"))
        assert sharding.SlotMap.load(spark, str(tmp_path / "map"), m.version) == m
    with pytest.raises(Exception, match="(?i)exists"):
        first.save(spark, str(tmp_path / "map"))


def test_shards_odd_input(spark):
    rows = [(1, None, 1), (None, "a", 1), (2, "", 1), *[(3, "same" * 500, 1)] * 300, (4, "very long " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    got = sharding.assign(df, 16)[0].collect()
    assert len(got) == 304
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    rest = sorted(load.values())[:-1]  # the very long text has a shard to itself
    assert max(rest) - min(rest) <= 4002 and max(load.values()) == 400_001
    assert len({r.virtual_slot for r in got if r.doc_id == 3}) > 250
    assert {r.size for r in got if r.doc_id == 1} == {1}
    assert sharding.assign(df.limit(0), 16)[0].collect() == []


def test_sql(spark, sf_dir):
    from compare import connect, rows_of, rows_of_sql, same

    con = connect(sf_dir)
    for name, sql in catalogue.SQL.items():
        cols, got = rows_of(catalogue.QUERIES[name](spark, sf_dir))
        want_cols, want = rows_of_sql(con, sql)
        assert cols == want_cols and same(got, want), name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline
    from test_dedup import exact, near
    from test_texts import check_packing, plain_base
    from weirflow.llm.staging import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = {"documents": docs}
    now = docs
    for name, step in pipeline.STAGES[:-1]:
        now = stage(step(spark, now, sf_dir), name)
        assert now.columns == docs.columns
        at[name] = now
    texts = {k: {r.doc_id: r.text for r in v.collect()} for k, v in at.items()}
    assert texts["language"].keys() >= {i for i, t in texts["documents"].items() if t and any(map(str.isalpha, t))}
    assert texts["exact"].keys() == {max(g) for g in exact(texts["language"].items()).values()}
    classes = defaultdict(list)
    for i, c in near(sorted(texts["exact"].items())).items():
        classes[c].append(i)
    assert texts["near"].keys() == {min(g) for g in classes.values()}
    assert texts["secrets"].keys() == texts["near"].keys()
    assert not any(plain_base(t) for t in texts["secrets"].values())
    check_packing(pipeline.run(spark, sf_dir).collect(), texts["secrets"].items())
