"""Exact top-k search by inner product, with cover trees over queries and data.

Queries and data are dealt to cells alike: the cell of a vector is its nearest pivot, pivots
being a sample of at most ``PIVOTS`` vectors. A pivot is a vector of the data as well, so the
k-th best of them is a lower bound of a query's k-th score from the start. A query block goes
to those cells only that can beat it: nothing in a cell scores more than ``q.p + |q| R``, R
being the distance from pivot p that covers the cell. Cells that are large, as where a third of
all vectors are copies, are cut into parts by row.

The vectors of a cell are indexed as a cover tree: a node has a centre among its points, the
radius that covers all points below it, and children whose centres are more than half that
radius apart. Searching a query block against a data block descends both trees at once. No
point under a data node can score more with a query under a query node than
``q.c + Rq|c| + Rc|q| + Rq Rc``; the pair is left out when that is below the worst k-th score
among the node's queries. Node pairs with few points are multiplied out. Scores found in one
data block prune the following ones. Everything is exact: components are integers, products are
taken in doubles only where all sums stay below 2**53 and in Python's integers otherwise, and
bounds carry a margin for rounding. The sample decides what is pruned, never what is found.

Defined results for odd input: vectors that are null or hold null or non-finite components
take no part; vectors of different length never meet; an empty vector scores 0. Ties go to
the smaller id. Equal rows are separate candidates, also for one another; a null id comes
last. With fewer candidates than k all are returned; an empty table gives an empty result.
Scores beyond 64 bits raise an error. Only the id and vector columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fingerprints import bounded
from .staging import discard, stage, table

K = 10
SCALE = 1024
#: Vectors of a block, and points that are multiplied out without a further split.
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
LEAF = 64
#: Pivots at most, also by their size, and vectors that a cell should have.
PIVOTS, PIVOT_BYTES, CELL = 4096, 32 << 20, 2048
#: Query blocks whose best candidates a task holds at a time.
TOGETHER = 64
_LAST = np.iinfo(np.int64).max


@dataclass
class Node:
    """Points first..first+n of the block's order, all within radius of the centre."""

    centre: np.ndarray
    radius: float
    first: int
    n: int
    children: list[Node]


@dataclass
class Block:
    """Vectors in the order of their tree."""

    vectors: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    root: Node
    largest: int
    #: A lower bound of the k-th score of each vector, where it is a query.
    floor: np.ndarray


def build(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray | None = None) -> Block:
    """A cover tree over the rows of ``vectors`` (int64)."""
    points = vectors.astype(np.float64)
    order: list[int] = []

    def leaf(members: np.ndarray, centre: np.ndarray) -> Node:
        first = len(order)
        order.extend(members.tolist())
        away = np.sqrt(((points[members] - centre) ** 2).sum(axis=1)).max() if len(members) else 0.0
        return Node(centre, float(away), first, len(members), [])

    def grow(members: np.ndarray, away: np.ndarray) -> Node:
        """members[0] is the centre; away: distances to it."""
        centre, radius = points[members[0]], float(away.max())
        if len(members) <= LEAF or radius == 0:
            return leaf(members, centre)
        first, children, few = len(order), [], []
        while len(members):
            # the centre is its own first child; each next centre is over radius / 2 from those before
            if children or few:
                away = np.sqrt(((points[members] - points[members[0]]) ** 2).sum(axis=1))
            near = away <= radius / 2
            if near.sum() > LEAF // 4:
                children.append(grow(members[near], away[near]))
            else:
                few.append(members[near])
            members, away = members[~near], away[~near]
        # lone points, too few for nodes of their own, share leaves
        lone = np.concatenate(few) if few else np.empty(0, dtype=np.int64)
        for at in range(0, len(lone), LEAF):
            part = lone[at : at + LEAF]
            children.append(leaf(part, points[part].mean(axis=0)))
        return Node(centre, radius, first, len(order) - first, children)

    everything = np.arange(len(points))
    root = grow(everything, np.sqrt(((points - points[0]) ** 2).sum(axis=1)))
    at = np.array(order)
    floor = np.full(len(points), -np.inf) if floor is None else floor
    return Block(vectors[at], ids[at], rows[at], root, int(np.abs(vectors).max(initial=0)), floor[at])


def products(q: np.ndarray, d: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows as int64."""
    if exact:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    out = q.astype(object) @ d.astype(object).T
    if out.size and max(abs(int(out.max())), abs(int(out.min()))) > _LAST:
        raise OverflowError("a score doesn't fit 64 bits")
    return out.astype(np.int64)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: Block, k: int):
        n = len(queries.ids)
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, dtype=np.int64)
        self.id = np.full((n, k), _LAST, dtype=np.int64)
        self.row = np.full((n, k), -1, dtype=np.int64)
        #: Lower bound of the k-th score of each query.
        self.worst = queries.floor.copy()

    def merge(self, at: slice, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, valid: np.ndarray) -> None:
        """Takes candidates (columns) for the queries ``at`` (rows)."""
        some = valid & (score >= self.worst[at][:, None])
        for i in np.flatnonzero(some.any(axis=1)):
            j, c = at.start + i, np.flatnonzero(some[i])
            s, d, r = np.append(self.score[j], score[i, c]), np.append(self.id[j], ids[c]), np.append(self.row[j], rows[c])
            real = r >= 0
            best = np.lexsort((r, d, -s.astype(np.float64) if abs(s).max() < 1 << 53 else [-int(x) for x in s], ~real))[: self.k]
            self.score[j], self.id[j], self.row[j] = s[best], d[best], r[best]
            if (self.row[j] >= 0).all():
                self.worst[j] = max(self.worst[j], self.score[j, -1])


def search(queries: Block, data: Block, best: Best) -> int:
    """Descends both trees; returns how many products were taken."""
    dim = queries.vectors.shape[1]
    exact = queries.largest * data.largest * max(dim, 1) < 1 << 53
    taken = 0

    def bounds(q: Node, nodes: list[Node]) -> np.ndarray:
        centres = np.array([d.centre for d in nodes])
        radius = np.array([d.radius for d in nodes])
        size = np.sqrt((centres**2).sum(axis=1))
        norm = float(np.sqrt((q.centre**2).sum()))
        top = centres @ q.centre + q.radius * size + radius * norm + q.radius * radius
        return top + 1e-9 * (1 + norm * size + q.radius * size + radius * norm + q.radius * radius)

    def multiply(q: Node, d: Node) -> None:
        nonlocal taken
        at = slice(q.first, q.first + q.n)
        for first in range(d.first, d.first + d.n, 1024):
            part = slice(first, min(first + 1024, d.first + d.n))
            score = products(queries.vectors[at], data.vectors[part], exact)
            taken += score.size
            best.merge(at, score, data.ids[part], data.rows[part], queries.rows[at][:, None] != data.rows[part][None, :])

    def descend(q: Node, nodes: list[Node]) -> None:
        top = bounds(q, nodes)
        order = np.argsort(-top, kind="stable")
        if q.children:
            worst = best.worst[q.first : q.first + q.n].min()
            kept = [nodes[i] for i in order if top[i] >= worst]
            wider = [c for d in kept for c in (d.children or [d])]
            for child in q.children:
                descend(child, wider)
            return
        queue = [(top[i], nodes[i]) for i in order]
        while queue:
            bound, d = queue.pop(0)
            if bound < best.worst[q.first : q.first + q.n].min():
                return  # all others are lower
            if not d.children:
                multiply(q, d)
                continue
            queue = sorted([*queue, *zip(bounds(q, d.children), d.children, strict=True)], key=lambda x: -x[0])

    if len(queries.ids) and len(data.ids):
        descend(queries.root, [data.root])
    return taken


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per usable row: number, id, length and the components floor(scale * x) as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, data, dims = [], [], []
            for i, v in enumerate(b.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                y = np.floor(scale * x)
                if np.abs(y).max(initial=0) >= 2.0**63:
                    raise OverflowError("a component doesn't fit 64 bits")
                keep.append(i)
                data.append(y.astype("<i8").tobytes())
                dims.append(len(y))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["rid", "vec_id", "dim", "data"])

    picked = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return picked.mapInArrow(run, "rid long, vec_id long, dim int, data binary")


@dataclass
class Pivots:
    """The pivots of one length."""

    points: np.ndarray
    rows: np.ndarray
    first: int

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with all pivots, and how far rounding may have moved them."""
        size = np.sqrt((x**2).sum(axis=1))[:, None] * np.sqrt((self.points**2).sum(axis=1)).max(initial=0)
        return x @ self.points.T, 1e-9 * (1 + size)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and a bound of its distance from the pivot."""
        top, _ = self.products(x)
        at = ((self.points**2).sum(axis=1)[None, :] - 2 * top).argmin(axis=1)
        away = np.sqrt(((x - self.points[at]) ** 2).sum(axis=1))
        return at + self.first, away * (1 + 1e-9)

    def floors(self, x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of the k-th score of each vector among all rows but its own."""
        if len(self.points) <= k:
            return np.full(len(x), -np.inf)
        top, margin = self.products(x)
        top[rows[:, None] == self.rows[None, :]] = -np.inf
        return np.partition(top, len(self.points) - k, axis=1)[:, len(self.points) - k] - margin[:, 0]

    def reached(self, x: np.ndarray, floor: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The cells in which some of the vectors may have a score at its floor or above."""
        top, margin = self.products(x)
        norm = np.sqrt((x**2).sum(axis=1))[:, None] * (1 + 1e-9)
        return np.flatnonzero((top + margin + norm * radius[None, :] >= floor[:, None]).any(axis=0)) + self.first


def pivots(usable: DataFrame) -> dict[int, Pivots]:
    """Different vectors of a sample of the rows, by length; cells are numbered through."""
    figures = usable.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    wanted = min(PIVOTS, max(4 * K, -(-figures.n // CELL)), max(1, PIVOT_BYTES // (8 * max(figures.dim or 1, 1))))
    by: dict[int, dict[bytes, int]] = {}
    for r in usable.orderBy(F.xxhash64("rid"), "rid").limit(wanted).collect():
        by.setdefault(r.dim, {}).setdefault(bytes(r.data), r.rid)
    out, first = {}, 0
    for dim, found in sorted(by.items()):
        points = np.frombuffer(b"".join(found), dtype="<i8").reshape(len(found), dim).astype(np.float64)
        out[dim] = Pivots(points, np.array(list(found.values()), dtype=np.int64), first)
        first += len(found)
    return out


def in_cells(usable: DataFrame, k: int, chosen: dict[int, Pivots]) -> DataFrame:
    """``usable`` with cell, distance from its pivot, and for queries (``asked``) the floor of the k-th score.

    Lengths without a pivot have one cell each, -1.
    """
    shared = usable.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                dims, asked = part.column(2).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)
                rows, data = part.column(0).to_numpy(), part.column(3).to_pylist()
                cell, away, floor = np.full(len(dims), -1), np.zeros(len(dims)), np.full(len(dims), -np.inf)
                for dim in np.unique(dims):
                    if (p := shared.value.get(int(dim))) is not None:
                        some = np.flatnonzero(dims == dim)
                        x = np.frombuffer(b"".join(data[i] for i in some), dtype="<i8").reshape(len(some), dim).astype(np.float64)
                        cell[some], away[some] = p.nearest(x)
                        if len(q := np.flatnonzero(asked[some])):
                            floor[some[q]] = p.floors(x[q], rows[some[q]], k)
                cols = [*part.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64()), pa.array(floor, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "vec_id", "dim", "data", "asked", "cell", "away", "floor"])

    return usable.select("rid", "vec_id", "dim", "data", "asked").mapInArrow(run, "rid long, vec_id long, dim int, data binary, asked boolean, cell int, away double, floor double")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Cover trees over up to ``size`` vectors of one (dim, cell, part) each; rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        key: tuple[int, int, int] = (0, 0, 0)

        def block() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(w[2] for w in waiting), dtype="<i8").reshape(len(waiting), key[0])
            ids = np.array([_LAST if w[1] is None else w[1] for w in waiting], dtype=np.int64)
            tree = build(x, ids, np.array([w[0] for w in waiting], dtype=np.int64), np.array([w[3] for w in waiting]))
            waiting.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in key), pa.array([pickle.dumps(tree)], pa.binary())], ["dim", "cell", "part", "block"])

        for b in batches:
            for dim, cell, part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting and ((dim, cell, part) != key or len(waiting) >= size):
                    yield block()
                key = (dim, cell, part)
                waiting.append(row)
        if waiting:
            yield block()

    ordered = rows.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
    return ordered.select("dim", "cell", "part", "rid", "vec_id", "data", "floor").mapInArrow(run, "dim int, cell int, part int, block binary")


def targets(queries: DataFrame, chosen: dict[int, Pivots], radius: np.ndarray) -> DataFrame:
    """Each query block with the cells that it must be searched in."""
    shared = queries.sparkSession.sparkContext.broadcast((chosen, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, radii = shared.value
        for b in batches:
            found = []
            for dim, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                asked: Block = pickle.loads(block.as_buffer())
                p = known.get(dim)
                found.append([-1] if p is None else p.reached(asked.vectors.astype(np.float64), asked.floor, radii[p.first : p.first + len(p.points)]).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], ["dim", "block", "query_block", "cells"])

    return queries.select("dim", "block", "query_block").mapInArrow(run, "dim int, block binary, query_block long, cells array<int>")


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k best candidates of each query row among all other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Query blocks meet the data blocks of their target
    cells by an equi-join, a part of a cell at a time.
    """
    usable = stage(vectors(rows, id_col, vector_col, scale).withColumn("asked", F.coalesce(is_query, F.lit(False))), "vectors")
    chosen = pivots(usable)
    placed = stage(in_cells(usable, k, chosen), "cells")
    sizes = stage(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / DATA_BLOCK).cast("int").alias("parts"), F.max("away").alias("radius")), "sizes")
    radius = np.full(sum(len(p.points) for p in chosen.values()), -np.inf)  # of cells with nothing in them
    for r in sizes.where("cell >= 0").collect():  # as many as pivots at most
        radius[r.cell] = r.radius
    dealt = placed.join(bounded(sizes, sizes.count()), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    data = stage(blocks(dealt, 2 * DATA_BLOCK), "data")
    queries = stage(blocks(dealt.where("asked"), QUERY_BLOCK).withColumn("query_block", F.monotonically_increasing_id()), "queries")
    each = targets(queries, chosen, radius).select("dim", F.col("block").alias("query"), "query_block", F.explode("cells").alias("cell"))
    each = each.join(bounded(sizes.select("dim", "cell", "parts"), sizes.count()), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = each.join(data, ["dim", "cell", "part"]).select("query_block", "query", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, Best]] = {}
        last: tuple[bytes, Block] | None = None

        def rows_of(asked: Block, best: Best) -> pa.RecordBatch:
            i, j = np.nonzero(best.row >= 0)
            cols = [asked.rows[i], asked.ids[i], best.id[i, j], best.row[i, j], best.score[i, j]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_row", "query_id", "vec_id", "row", "score"])

        for b in batches:
            for number, query, block in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if number not in held:
                    if len(held) >= TOGETHER:
                        yield rows_of(*held.pop(next(iter(held))))
                    asked = pickle.loads(query.as_buffer())
                    held[number] = (asked, Best(asked, k))
                if last is None or last[0] != block:
                    last = (block, pickle.loads(block))
                search(held[number][0], last[1], held[number][1])
        for found in held.values():
            yield rows_of(*found)

    found = pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    discard(usable, placed)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(_LAST)).alias("vec_id"), "score")


def op4_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of each vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


QUERIES = {"op4_dual_tree_top_k": op4_dual_tree_top_k}
SQL = {
    "op4_dual_tree_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
    """,
}
