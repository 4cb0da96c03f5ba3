"""Near-duplicate documents with ProbMinHash.

A document is the multiset of its five-word shingles; the weight of a shingle is how often it
occurs. For each shingle a Poisson process of that rate yields arrivals, each at a random
register; a register keeps the shingle of its earliest arrival. A shingle is done as soon as
its next arrival is later than all registers' values, so most stop after a few. Two documents
agree in a register with probability J_P, their probability Jaccard similarity (which is the
Jaccard similarity where all weights are equal). Registers are banded, documents that agree in
a band are candidates, and candidates are verified exactly: J_P of 0.8 or more is a link.

No group is ever expanded into all pairs. Documents of equal shingles are one node. Each
bucket's members are compared with its leader, and connected components follow; then again
with another leader, where members are still in different components. Only what is in
different components after that is compared with each other, by blocks of a bucket, bounded in
members and in shingles (see ``block_links``). Buckets are lists of node numbers; registers and
shingles are joined to the pairs that need them. All comparisons begin with a byte of each of
126 registers: pairs that agree in fewer than ``AGREEING`` of them, which happens to one linked
pair in 100,000, are not verified. No other link between candidates is lost. Tables written on
the way are deleted as soon as nothing reads them.

Defined results for odd input: words are lower-cased and split at white space; a text of one
to four words has one shingle, all of it; a null text, or one without a word, is a class of
its own; very long texts are read whole. Null ids are carried along and never name a class of others. Equal rows are members
of one class, of which one row is kept. An empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .fingerprints import bounded, without_rows
from .staging import discard, handed_on, stage, table

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
#: At similarity 0.8 a pair is missed with probability (1 - 0.8**5)**25, below 1 in 10,000.
BANDS, ROWS = 25, 5
#: Registers compared before verification, packed seven to a word, and how many must agree.
WORD, PACKED, AGREEING = 7, 126, 82
#: Times that buckets get new leaders before what is left is compared with each other.
LEADERS = 2
#: Members of a bucket, and shingles of theirs, that stand in one block; blocks meet in pairs.
BLOCK, HELD = 1024, 1 << 21
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: number of the text, shingle's hash, how often it occurs there; sorted."""
    words = [(x or "").lower().split() for x in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array([w for ws in words for w in ws], dtype=object)
    if not len(flat):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h = pd.util.hash_array(flat, categorize=False).astype(np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the text's end
    out = np.zeros(len(h), dtype=np.uint64)
    padded = np.concatenate((h, np.zeros(WORDS - 1, dtype=np.uint64)))
    for i in range(WORDS):
        out = mixed(out + np.where(left > i, padded[i : i + len(h)], np.uint64(i)) + _A)
    first = np.repeat(np.cumsum(n) - n, n) == np.arange(len(h))
    valid = (left >= WORDS) | first
    doc, out = doc[valid], out[valid]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    at = np.flatnonzero(new)
    return doc[at], out[at], np.diff(np.append(at, len(doc)))


def sketches(doc: np.ndarray, items: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each document and register, the item of the earliest arrival (0 without items)."""
    value = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, dtype=np.uint64)
    time, rate = np.zeros(len(items)), weights.astype(np.float64)
    doc, left, turn = doc.astype(np.int64), items, 0
    while len(left):
        turn += 1
        drawn = mixed(left + np.uint64(int(_A) * turn % (1 << 64)))
        time = time - np.log1p(-(drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        place = doc * registers + (mixed(drawn ^ _C) % np.uint64(registers)).astype(np.int64)
        sooner = time < value[place]
        at, t, who = place[sooner], time[sooner], left[sooner]
        np.minimum.at(value, at, t)
        won = value[at] == t
        owner[at[won]] = who[won]
        last = value.reshape(n_docs, registers).max(axis=1)
        on = time < last[doc]
        doc, left, time, rate = doc[on], left[on], time[on], rate[on]
    return owner.reshape(n_docs, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, each as sorted items and weights."""
    # the items of b that stand in a, both being sorted
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    j = np.flatnonzero(a[0][at] == b[0]) if len(a[0]) else np.empty(0, dtype=np.int64)
    i = at[j]
    if not len(j):
        return 0.0
    if (a[1] == 1).all() and (b[1] == 1).all():
        return len(j) / (len(a[0]) + len(b[0]) - len(j))
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    cx, cy = x[i], y[j]
    alone_x, alone_y = x.sum() - cx.sum(), y.sum() - cy.sum()
    # of the items in order of x/y, those above an item's own ratio count with x, the rest with y
    ratio = cx / cy
    order = np.argsort(ratio, kind="stable")
    cx, cy, ratio = cx[order], cy[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    sum_x, sum_y = np.concatenate(([0.0], np.cumsum(cx))), np.concatenate(([0.0], np.cumsum(cy)))
    above = alone_x + sum_x[-1] - sum_x[upto]
    below = alone_y + sum_y[upto]
    return float((1.0 / (above / cx + below / cy)).sum())


def sketched(texts: DataFrame) -> DataFrame:
    """Per row of (rid, doc_id, text): number, id, fingerprint of the shingles in two words, band hashes, a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                size, n = 0, 0  # about a million characters at a time
                while at + n < b.num_rows and n < 1000 and size < 1 << 20:
                    size += len(b.column(2)[at + n].as_py() or "")
                    n += 1
                part = b.slice(at, n)
                at += n
                doc, items, weights = shingles(part.column(2).to_pylist())
                owner = sketches(doc, items, weights, n)
                bands = np.zeros((n, BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    bands = mixed(bands + owner[:, k * BANDS : (k + 1) * BANDS] + _A)
                bands = mixed(bands + np.arange(BANDS, dtype=np.uint64) * _B).astype(np.int64)
                low = (mixed(owner[:, :PACKED]) & np.uint64(255)).reshape(n, -1, WORD)
                words = (low << (np.arange(WORD, dtype=np.uint64) * np.uint64(8))).sum(axis=2, dtype=np.uint64).astype(np.int64)
                n_items = np.bincount(doc, minlength=n)
                pair = mixed(items + mixed(weights.astype(np.uint64))), mixed(items ^ mixed(weights.astype(np.uint64) + _C))
                sums = [np.zeros(n, dtype=np.uint64) for _ in pair]
                for s, p in zip(sums, pair, strict=True):
                    np.add.at(s, doc, mixed(p))
                cols = [part.column(0), part.column(1)]
                cols += [pa.array(s.astype(np.int64), pa.int64(), mask=n_items == 0) for s in sums]
                cols += [pa.array([x if y else [] for x, y in zip(bands, n_items, strict=True)], pa.list_(pa.int64())), pa.array(list(words), pa.list_(pa.int64())), pa.array(n_items, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "fp1", "fp2", "bands", "words", "n_items"])

    return texts.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, fp1 long, fp2 long, bands array<long>, words array<long>, n_items int")


def alike(a: Column, b: Column) -> Column:
    """Whether enough registers agree. Seven bytes a word, so that sums don't overflow."""
    ones, high = F.lit(0x007F7F7F7F7F7F7F), F.lit(0x0080808080808080)

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        return F.bit_count((x.bitwiseAND(ones) + ones).bitwiseOR(x).bitwiseAND(high))

    return sum((differing(i) for i in range(1, PACKED // WORD)), differing(0)) <= PACKED - AGREEING


def sets(texts: DataFrame) -> DataFrame:
    """Per row of (rid, text): the shingles as sorted hashes, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                doc, items, weights = shingles(part.column(1).to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32))
                cols = [part.column(0), pa.ListArray.from_arrays(ends, pa.array(items.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(weights.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "items", "weights"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, items array<long>, weights array<int>")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes that are links, as a table. A node's shingles are hashed once, however many pairs it is in."""
    needed = stage(pairs.select(F.col("u").alias("rid")).union(pairs.select(F.col("v").alias("rid"))).distinct(), "needed")
    own = stage(sets(texts.join(bounded(needed, needed.count()), "rid", "left_semi")), "own")
    both = pairs.join(own.toDF("u", "items_u", "weights_u"), "u").join(own.toDF("v", "items_v", "weights_v"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [(c.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))))) for c in b.columns[2:]]

            def part(c: int, i: int) -> np.ndarray:
                return flat[c][0][flat[c][1][i] : flat[c][1][i + 1]]

            sim = [similarity((part(0, i).view(np.uint64), part(1, i)), (part(2, i).view(np.uint64), part(3, i))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], ["u", "v", "sim"])

    sim = both.select("u", "v", "items_u", "weights_u", "items_v", "weights_v").mapInArrow(run, "u long, v long, sim double")
    out = stage(sim.where(F.col("sim") >= least).select("u", "v"), "links")
    discard(needed, own)
    return out


def block_links(members: DataFrame, marks: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between members (band, node, comp) of one bucket in different components, as a table.

    A bucket is cut into blocks of about BLOCK members and HELD shingles at most, one member at
    least, and a task takes a pair of blocks. It compares registers as matrices and verifies
    what agrees, most alike first; members that its own links have joined meanwhile aren't
    compared again. A pair is looked at in the first band that both share.
    """
    nodes = stage(members.select("node").distinct(), "nodes")
    n_nodes = nodes.count()
    shingled = sets(texts.join(bounded(nodes.select(F.col("node").alias("rid")), n_nodes), "rid", "left_semi")).withColumnRenamed("rid", "node")
    own = stage(shingled.join(marks.select("node", "bands", "words"), "node"), "own")
    sized = members.join(bounded(own.select("node", F.size("items").alias("n_items")), n_nodes), "node")
    # buckets of more than one block are few: each has hundreds of members, or very long ones
    blocks = sized.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (BLOCK * 0.9)), F.ceil(F.sum(F.col("n_items").cast("long")) / HELD)).cast("int").alias("n_blocks"))
    blocks = stage(blocks.where("n_blocks > 1"), "blocks")
    placed = members.join(bounded(blocks, blocks.count()), "band", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("n_blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = paired.join(own, "node").select("band", "i", "j", "node", "comp", "block", "bands", "words", "items", "weights")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = len(g)
        registers = np.stack(g["words"].to_numpy()).astype(np.int64).view(np.uint8).reshape(n, -1, 8)[:, :, :WORD].reshape(n, -1)
        bands, comp, block = np.stack(g["bands"].to_numpy()), g["comp"].to_numpy(), g["block"].to_numpy()
        node, band = g["node"].to_numpy(), g["band"].iloc[0]
        crossing = g["i"].iloc[0] != g["j"].iloc[0]
        found: list[tuple[int, int, int]] = []
        for x in range(n - 1):
            y = np.arange(x + 1, n)
            y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) | (not crossing))]
            agreed = (registers[y] == registers[x]).sum(axis=1)
            y, agreed = y[agreed >= AGREEING], agreed[agreed >= AGREEING]
            if len(y):
                same = bands[y] == bands[x]
                y, agreed = (z[bands[x][same.argmax(axis=1)] == band] for z in (y, agreed))
                found += [(-a, x, k) for a, k in zip(agreed.tolist(), y.tolist(), strict=True)]
        up = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        items = [(a.astype(np.int64).view(np.uint64), w) for a, w in zip(g["items"], g["weights"], strict=True)]
        out = []
        for _, x, y in sorted(found):
            a, b = root(comp[x]), root(comp[y])
            if a != b and similarity(items[x], items[y]) >= least:
                up[max(a, b)] = min(a, b)
                out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    out = stage(rows.groupBy("band", "i", "j").applyInPandas(run, "u long, v long"), "links")
    discard(nodes, own, blocks)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, row_col: str | None = None) -> DataFrame:
    """Every row with its class (the least id in it), the size of the class, and whether it is the row that is kept.

    ``row_col`` names a column that numbers the rows of a table; it comes back as ``rid``.
    """
    rid = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    texts = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if row_col is None:
        texts = stage(texts, "texts")
    rows = stage(sketched(texts), "sketches")
    same = stage(rows.groupBy("fp1", "fp2").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1 AND fp1 IS NOT NULL").select("fp1", "fp2", "node"), "same")
    nodes = rows.join(bounded(same, same.count()), ["fp1", "fp2"], "left").withColumn("node", F.coalesce("node", "rid"))
    banded = nodes.where("node = rid").select("node", F.explode("bands").alias("band"))
    shared = stage(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "buckets")
    members = stage(banded.join(bounded(shared, shared.count()), "band").withColumn("comp", F.col("node")), "members")
    marks = rows.select(F.col("rid").alias("node"), "bands", "words")

    found = members.select("node", F.col("comp").alias("root")).limit(0)
    for turn in range(LEADERS + 1):
        if turn < LEADERS:
            lead = stage(members.groupBy("band").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("y")), "leaders")
            met = members.alias("x").join(bounded(lead, lead.count()), "band").where(F.col("x.comp") != F.col("y.comp"))
            pairs = stage(met.select(F.col("y.node").alias("u"), F.col("x.node").alias("v")).distinct(), "pairs")
            leaders = stage(marks.select(F.col("node").alias("u"), F.col("words").alias("words_u")).join(pairs.select("u").distinct(), "u", "left_semi"), "marks")
            marked = pairs.join(marks.select(F.col("node").alias("v"), "words"), "v").join(bounded(leaders, leaders.count()), "u")
            likely = stage(marked.where(alike(F.col("words_u"), F.col("words"))).select("u", "v"), "likely")
            new = verified(likely, texts, least)
            discard(lead, pairs, leaders, likely)
        else:
            new = block_links(members, marks, texts, least)
        before, found = found, components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new))
        discard(before, new)
        if turn == LEADERS:
            break
        placed = members.select("band", "node").join(bounded(found, found.count()), "node", "left").select("band", "node", F.coalesce("root", "node").alias("comp"))
        split = stage(placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band"), "split")
        before, members = members, stage(placed.join(bounded(split, split.count()), "band", "left_semi"), "members")
        discard(before, split)
        if members.isEmpty():
            break

    labelled = nodes.select("rid", "doc_id", "node").join(bounded(found, found.count()), "node", "left").withColumn("class", F.coalesce("root", "node"))
    labelled = stage(labelled.select("rid", "doc_id", "class"), "labels")
    named = labelled.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    named = stage(named.where("class_size > 1").select("class", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("kept_rid")), "classes")
    discard(texts, rows, same, shared, members, found)
    out = labelled.join(bounded(named, named.count()), "class", "left")
    alone = F.col("class_size").isNull()
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (alone | (F.col("rid") == F.col("kept_rid"))).alias("kept"), "rid")
    return handed_on(out, labelled, named)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns."""
    return without_rows(docs, lambda numbered, row: classes(numbered, id_col, text_col, row_col=row))


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return classes(table(spark, sf_dir, "documents")).drop("rid")


QUERIES = {"op5_prob_minhash": op5_prob_minhash}
SQL: dict[str, str] = {}
