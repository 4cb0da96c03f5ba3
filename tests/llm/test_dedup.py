"""Exact, near-duplicate and line dedup against brute force, and on odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from weirflow.llm import components, fingerprints, lines, neardup

SCHEMA = "doc_id long, text string, fp string, rid long, kept boolean"


def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, columns named as ours."""
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, "Abc one two three four five"), (4, "aBC one two three four five"), (4, "aBC one two three four five"), (None, "abc one two three four five"), (7, long), (8, long + "x"), (9, "É"), (10, "é"), (None, None)]
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_fingerprints_combine():
    fp = fingerprints.Fingerprint()
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (0, 1, 511, 512, 513, 5000)]
    whole = fp.many(data)

    def plain(d, p, r):
        h = 0
        for b in d:
            h = (h * r + b) % p
        return h

    for d, h in zip(data, whole, strict=True):
        assert h == tuple(plain(d, p, r) for p, r in zip(fp.moduli, fp.bases, strict=True))
        for cut in (0, len(d) // 3, len(d)):
            a, b = d[:cut], d[cut:]
            assert fp.combine(fp.many([a])[0], fp.many([b])[0], len(b)) == h
    assert fp.huge(data[-1] * 1000) == fp.many([data[-1] * 1000])[0]


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    return groups


@pytest.mark.parametrize("moduli", [fingerprints.MODULI, (251,)])
def test_exact_classes(spark, docs, moduli):
    """Also with a modulus so small that different texts share fingerprints."""
    found = fingerprints.classes(docs, moduli=moduli).collect()
    groups = exact((r.doc_id, r.text) for r in docs.collect())
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == want


def test_exact_odd_input(spark):
    rows = odd(spark)
    found = fingerprints.classes(rows).collect()
    assert len(found) == rows.count()
    assert sorted(r.group_size for r in found) == [1, 1, 1, 1, 3, 3, 3, 4, 4, 4, 4]
    assert sum(r.kept for r in found) == 6
    kept = fingerprints.distinct_texts(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [2, 4, 7, 8, 9, 10]
    assert fingerprints.classes(rows.limit(0)).collect() == []


def weights(text):
    _, items, n = neardup.shingles([text])
    return items, n


def test_similarity_is_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = {int(k): int(w) for k, w in zip(rng.integers(0, 30, 20), rng.integers(1, 6, 20), strict=True)}
        b = {int(k): int(w) for k, w in zip(rng.integers(0, 30, 20), rng.integers(1, 6, 20), strict=True)}
        every = a.keys() | b.keys()
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a.keys() & b.keys())
        arrays = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert abs(neardup.similarity(*arrays) - want) < 1e-12
    same = (np.array([1, 2], dtype=np.uint64), np.array([1, 1]))
    assert neardup.similarity(same, same) == 1.0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    items = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    a, b = np.sort(items[:220]), np.sort(items[40:])
    w = rng.integers(1, 4, 300)
    sets = [(x, w[: len(x)]) for x in (a, b)]
    truth = neardup.similarity(*sets)
    doc = np.repeat([0, 1], [len(a), len(b)])
    got = neardup.sketches(doc, np.concatenate((a, b)), np.concatenate([s[1] for s in sets]), 2, 4096)
    assert abs((got[0] == got[1]).mean() - truth) < 0.04


def near(rows):
    sets = [(i, weights(t)) for i, t in rows]
    at = defaultdict(list)
    union = Union()
    for k, (_, (items, _)) in enumerate(sets):
        union.find(k)
        for x in items.tolist():
            at[x].append(k)
    for x, y in {(x, y) for ks in at.values() for x in ks for y in ks if x < y}:
        if neardup.similarity(sets[x][1], sets[y][1]) >= 0.8:
            union.join(x, y)
    return {i: union.find(k) for k, (i, _) in enumerate(sets)}


def test_near_classes(spark, docs):
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    want = near([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    by = defaultdict(set)
    for i, c in want.items():
        by[c].add(i)
    assert found == {i: min(by[c]) for i, c in want.items()}


@pytest.mark.parametrize(("leaders", "block"), [(2, 1024), (0, 40)])
def test_near_chain_and_large_group(spark, monkeypatch, leaders, block):
    """Neighbours of a chain are links and its ends are not; a group of many copies with one word changed.

    With leaders, and by blocks alone.
    """
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    monkeypatch.setattr(neardup, "BLOCK", block)
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[:0] + ["x%d" % j for j in range(k * 6)] + words[k * 6 :]) for k in range(6)]
    base = [f"v{i}" for i in range(300)]
    copies = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(200)]
    rows = [(i, t) for i, t in enumerate(chain + copies)]
    found = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = near(rows)
    assert len(set(found.values())) == len(set(want.values())) == 2
    assert all(found[i] == (0 if i < 6 else 6) for i in found)


def test_near_odd_input(spark):
    rows = odd(spark)
    found = neardup.classes(rows).collect()
    assert len(found) == rows.count()
    assert sorted(r.class_size for r in found) == [1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4]
    assert {r.class_id for r in found if r.class_size == 4} == {3}
    kept = neardup.one_of_each(rows)
    assert kept.columns == rows.columns
    assert kept.count() == 6
    assert neardup.classes(rows.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: got.get(x, x) for e in edges for x in e} == {x: union.find(x) for e in edges for x in e}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, a, n):
    b = list(a)
    for _ in range(n):
        k, what = rng.randrange(len(b) + 1), rng.random()
        if what < 0.34 or k == len(b):
            b.insert(k, rng.choice("abcé"))
        elif what < 0.67:
            del b[k]
        else:
            b[k] = rng.choice("abcé")
    return "".join(b)


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(15)))
        b = edited(rng, a, rng.randrange(5))
        for tau in (0, 1, 2, 3):
            assert lines.within(a, b, tau) == (distance(a, b) <= tau)


def brute_lines(rows, near=lambda x, y, edits: distance(x, y) <= edits):
    occurrences = sorted((-1 if i is None else i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x)
    first, links, union = {}, Counter(), Union()
    for i, k, x in occurrences:
        first.setdefault(x, (i, k))
        union.find(x)
    every = list(first)
    for n, x in enumerate(every):
        for y in every[n + 1 :]:
            edits = min(2, max(len(x), len(y)) // 6)
            if abs(len(x) - len(y)) <= edits and near(x, y, edits):
                links[x] += 1
                links[y] += 1
                union.join(x, y)
    least = {}
    for x in first:
        c = union.find(x)
        least[c] = min(least.get(c, (1 << 60, 0)), first[x])
    out = {}
    for i, k, x in occurrences:
        n, m, kept = out.setdefault(i, [0, 0, []])
        out[i] = [n + 1, m + links[x], [*kept, k] if least[union.find(x)] == (i, k) else kept]
    return out


def test_line_join(spark):
    """Lines of few letters with up to four edits, so that many are near the limit."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(2, 30))) for _ in range(40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(5)) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    assert {r.doc_id: [r.n_lines, r.n_links, r.kept] for r in found} == want
    assert sum(w[1] for w in want.values()) > 100


def test_short_lines_are_joined(spark):
    """At the lengths where one more edit is allowed, and below, where none is."""
    rows = [(1, "menu\nmenus\nnemu\nhome\n12345\n12346"), (2, "search\nserch\nsearchx\nsarchx"), (3, "abcdefghijk\nabcdefghijkl\nabcdefghij\nbcdefghijk\nxbcdefghijk")]
    found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [r.n_lines, r.n_links, r.kept] for r in found} == brute_lines(rows)
    assert {r.doc_id: r.n_kept for r in found} == {1: 6, 2: 1, 3: 1}


def test_line_join_of_a_crowded_key(spark):
    """Over HOT lines that share a segment."""
    rng = random.Random(7)
    tail = "the very same end of all of these lines, as it is long"
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(20)) + tail) for i in range(3 * lines.HOT)]
    rows += [(1000 + i, edited(rng, t, 2)) for i, t in rows[:50]]
    found = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [r.n_lines, r.n_links, r.kept] for r in found} == brute_lines(rows)


def test_line_odd_input(spark):
    rows = odd(spark).union(spark.createDataFrame([(11, "\n\n", "", 0, True), (12, "same line, long enough\nsame line, long enough!\nabc", "", 0, True)], SCHEMA))
    found = lines.dedup(rows).collect()
    assert len(found) == rows.count()
    by = {r.doc_id: (r.n_lines, r.n_kept, r.n_links) for r in found if r.doc_id in (1, 2, 11, 12)}
    assert by == {1: (0, 0, 0), 2: (0, 0, 0), 11: (0, 0, 0), 12: (3, 2, 2)}
    assert sum(r.n_kept for r in found if r.doc_id == 4) == 0  # the row with a null id comes first
    assert lines.cleaned("a\n\nb\nc", [0, 3]) == "a\n\nc"
    assert lines.dedup(rows.limit(0)).collect() == []
