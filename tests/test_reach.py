"""Edges by JSON values, and reachability."""

from pyspark.sql import functions as F

from weirflow.operators import reach

A, B, C, D = (f"hs2:{c * 64}" for c in "abcd")


def test_digests_are_whole_string_values(spark):
    bodies = [
        (1, f'{{"head": "{A}", "list": ["{B}", {{"x": "{C}"}}]}}'),
        (2, f'{{"{A}": 1, "k": "{B} "}}'),  # a key, and a string that is longer
        (3, f'{{"k": "see \\"{A}", "back": "\\\\", "v" : "{D}"}}'),  # quoted inside a string; a string that ends with a backslash
        (4, None),
        (5, "no json"),
    ]
    got = {(r.src, r.dst) for r in reach.digest_edges(spark.createDataFrame(bodies, "id long, body string"), "id", "body").collect()}
    assert got == {(1, A), (1, B), (1, C), (3, D)}


def test_reachable_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "e"), ("c", "gone")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("a",), ("lone",)], "node string")
    got = {r.node: r.depth for r in reach.reachable(roots, edges).collect()}
    assert got == {"a": 0, "lone": 0, "b": 1, "c": 2, "gone": 3}
    assert reach.reachable(roots.limit(0), edges).count() == 0
    assert reach.candidates(spark.createDataFrame([("e", 1)], "node string, d int").select("node", F.lit("2000-01-01").cast("timestamp").alias("modified")), reach.reachable(roots, edges), F.current_timestamp(), 30).count() == 1
