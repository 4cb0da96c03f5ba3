"""Line dedup by a segment-partition edit join.

Lines are links if they are within as many edits (code points inserted, deleted or replaced) of
each other as the longer one allows: one for each ``EACH`` of its characters, ``TAU`` at most.
So a line of under six characters is equal only to itself, one of six to eleven is linked by
one edit, all others by two. A line is split into one segment more than there are edits; of two
linked lines, some segment of the shorter occurs in the longer one, near its place. Keys are
hashes of (edits, length, segment number, segment) for each line, and of the substrings a longer
line must be probed with, chosen by the length-aware multi-match rule. Lines that can be linked
by one edit and by two have the keys for both. Keys that only one line has are dropped before
lines are put together. Two cheap exact filters come with the join: an edit flips at most two
bits of a parity word over characters and four of one over character pairs. A key with many
lines is split further by the pigeonhole principle: of 2 * TAU + 1 parts of the parity word one
agrees. Pairs that pass are verified by banded bit-parallel edit distance.

Equal lines are one node of the join, so copies are never paired. All links between different
lines are found and counted. Lines are classes under links and equality; of each class the
first line stays, by document id and line number.

Defined results for odd input: empty lines are never duplicates and aren't counted; a null or
empty text has no lines; rows with a null id come first. Very long lines are joined like all
others. Equal rows each get a result of their own, and at most one of them keeps a line. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .fingerprints import bounded
from .staging import stage, table

TAU = 2
#: Characters of the longer line for each edit.
EACH = 6
#: Lines of a key above which it is split by parity parts.
HOT = 64
PIECE = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a number and of its inverse, modulo 2**64."""
    if len(_POWERS.get(0, ())) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, PIECE), base, dtype=np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def allowed(n: int, tau: int = TAU) -> int:
    """Edits by which lines are linked, the longer one having n characters."""
    return min(tau, n // EACH)


def keys(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, tau: int = TAU) -> np.ndarray:
    """For each line its tau + 1 index keys, then its probe keys; lines are codes[start : start + n].

    A probe that is the line's own index key is left out: lines of equal index keys meet anyway.
    """
    power, inverse = _powers(len(codes) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + _MIX) * power[:-1])))

    def key(length: np.ndarray, i: int, shift: int) -> np.ndarray:
        """Of segment i of a line of that length, taken from this line ``shift`` places on."""
        size, longer = length // (tau + 1), length % (tau + 1)
        at = i * size + np.maximum(0, i - (tau + 1 - longer))
        size = size + (i >= tau + 1 - longer)
        a = starts + np.clip(at + shift, 0, None)
        b = np.minimum(a + size, starts + n)
        h = (sums[b] - sums[a]) * inverse[a]
        return _mixed(_mixed(h) + (length * (tau + 1) + i).astype(np.uint64) * _MIX2 + np.uint64(tau))

    out = [key(n, i, 0) for i in range(tau + 1)]
    for delta in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            out += [key(n - delta, i, s) for s in range(low, high + 1) if (delta, s) != (0, 0)]
    return np.stack(out, axis=1)


def all_keys(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all lines for every number of edits by which they can be linked, whether each is
    an index key, and the number of keys of each line. One matrix a number of edits."""
    made = []
    for edits in range(1, tau + 1):
        # as the shorter line of a pair or as the longer one
        most = EACH * (edits + 1) - 1 if edits < tau else None
        some = np.flatnonzero((n >= EACH * edits - edits) & (n <= most if most else True))
        k = keys(codes, starts[some], n[some], edits)
        made.append((some, k, np.arange(k.shape[1]) <= edits))
    counts = np.zeros(len(n), dtype=np.int64)
    for some, k, _ in made:
        counts[some] += k.shape[1]
    line = np.concatenate([np.repeat(some, k.shape[1]) for some, k, _ in made])
    order = np.argsort(line, kind="stable")
    flat = np.concatenate([k.ravel() for _, k, _ in made])
    own = np.concatenate([np.tile(o, len(some)) for some, _, o in made])
    return flat[order].astype(np.int64), own[order], counts


def parities(codes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words a line: which hashed characters, and pairs of characters, occur an odd number of times."""
    one = np.uint64(1) << (_mixed(codes.astype(np.uint64)) & np.uint64(63))
    two = np.zeros(len(codes), dtype=np.uint64)
    two[:-1] = np.uint64(1) << (_mixed(codes[:-1].astype(np.uint64) << np.uint64(21) | codes[1:].astype(np.uint64)) & np.uint64(63))
    # prefix sums under exclusive or
    a, b = (np.concatenate((np.zeros(1, dtype=np.uint64), np.bitwise_xor.accumulate(x))) for x in (one, two))
    return a[starts + n] ^ a[starts], b[np.maximum(starts, starts + n - 1)] ^ b[starts]


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Whether the edit distance is at most tau: vertical differences of a band of 2 * tau + 2 rows in one word."""
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b or not tau:
        return a == b
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= tau:
        return True
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    width = 2 * tau + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus = mask ^ ((1 << (width - tau - 1)) - 1), 0
    distance, side = tau, top >> 1
    for j, c in enumerate(b):
        at = j + tau + 1 - width
        hit = rows.get(c, 0)
        hit = (hit >> at if at >= 0 else hit << -at) & mask
        zero = ((((hit & plus) + plus) & mask) ^ plus) | hit | minus
        up, down = minus | (mask & ~(zero | plus)), zero & plus
        if j < len(a) - tau:
            distance += not zero & top
        else:
            distance += bool(up & side) - bool(down & side)
            side >>= 1
        if distance > 2 * tau + len(b) - len(a) + tau:
            return False
        plus, minus = down | (mask & ~((zero >> 1) | up)), (zero >> 1) & up
    return distance <= tau


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _groups(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some million bytes at a time."""
    size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(2)])
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, side="right")))
        yield b.slice(at, end - at)
        at = end


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """Per non-empty line: its row and number there, digest, length, keys, which are index keys, and parities.

    A line that the same task has met before comes without keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in batches:
            for part in _groups(b):
                texts = part.column(2).to_pylist()
                lines = [x.split("\n") for x in texts]
                count = np.array([len(x) for x in lines])
                flat = [y for x in lines for y in x]
                codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                n = np.array([len(x) for x in flat], dtype=np.int64)
                starts = np.cumsum(n + 1) - n - 1
                some = np.flatnonzero(n > 0)
                if not len(some):
                    continue
                digests = [xxhash.xxh3_128_digest(flat[i].encode("utf-8", "surrogatepass")) for i in some]
                fresh = np.zeros(len(some), dtype=bool)
                for k, d in enumerate(digests):
                    if d not in met:
                        met.add(d)
                        fresh[k] = True
                if len(met) > 500_000:
                    met.clear()
                starts, n = starts[some], n[some]
                keyed = np.flatnonzero(fresh)
                made, own, counts = all_keys(codes, starts[keyed], n[keyed], tau)
                size = np.zeros(len(n), dtype=np.int64)
                size[keyed] = counts
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                one, two = parities(codes, starts, n)
                doc = np.repeat(np.arange(len(texts)), count)[some]
                number = (np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count))[some]
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                take = pa.array(doc)
                cols = [part.column(0).take(take), part.column(1).take(take), pa.array(number, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int32())]
                cols += [pa.ListArray.from_arrays(offsets, pa.array(made, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(own)), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "line_no", "h1", "h2", "n", "keys", "own", "p1", "p2"])

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, rid long, line_no int, h1 long, h2 long, n int, keys array<long>, own array<boolean>, p1 long, p2 long")


def line_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest and text of every line that has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _groups(b):
                flat = list(dict.fromkeys(y for x in part.column(2).to_pylist() for y in x.split("\n") if len(y) >= EACH - 1))
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in flat), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(flat, pa.string())], ["h1", "h2", "line"])

    return _picked(docs, id_col, text_col).mapInArrow(run, "h1 long, h2 long, line string")


def candidates(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs of digests (h1, h2) < (g1, g2) that share a key and pass the filters."""
    each = lines.select("h1", "h2", "n", "p1", "p2", F.explode(F.arrays_zip("keys", "own")).alias("k")).select("h1", "h2", "n", "p1", "p2", "k.keys", "k.own").withColumnRenamed("keys", "key")
    live = each.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("own").alias("own")).where("own AND lo <> hi").select("key")
    live = stage(live, "keys")
    put = stage(each.join(bounded(live, live.count()), "key", "left_semi").distinct(), "keyed")
    crowded = put.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    # of 2 * tau + 1 parts of the parity word, one is the same in two linked lines
    size = 64 // (2 * tau + 1)
    split = F.array(*(F.xxhash64("key", F.lit(i), F.shiftrightunsigned("p1", i * size).bitwiseAND(F.lit((1 << size) - 1 if i < 2 * tau else (1 << (64 - i * size)) - 1))) for i in range(2 * tau + 1)))
    put = stage(put.join(crowded, "key", "left").withColumn("key", F.explode(F.when(F.col("hot"), split).otherwise(F.array("key")))).drop("hot"), "split")
    edits = F.least(F.lit(tau), F.floor(F.greatest("x.n", "y.n") / EACH))
    near: Column = (F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1"))) <= 2 * edits) & (F.bit_count(F.col("x.p2").bitwiseXOR(F.col("y.p2"))) <= 4 * edits) & (F.abs(F.col("x.n") - F.col("y.n")) <= edits)
    other = (F.col("x.h1") < F.col("y.h1")) | (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") < F.col("y.h2"))
    met = put.alias("x").join(put.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.own") | F.col("y.own")) & other & near)
    return met.select("x.h1", "x.h2", F.col("y.h1").alias("g1"), F.col("y.h2").alias("g2")).distinct()


def links(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """Verified pairs of digests of different lines within tau edits."""
    pairs = stage(candidates(lines, tau), "pairs")
    needed = stage(pairs.select("h1", "h2").union(pairs.select("g1", "g2")).distinct(), "needed")
    texts = stage(line_texts(docs, id_col, text_col).join(bounded(needed, needed.count()), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]), "texts")
    both = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other")), ["g1", "g2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([within(x, y, allowed(max(len(x), len(y)), tau)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.bool_())).select([0, 1, 2, 3])

    return both.select("h1", "h2", "g1", "g2", "line", "other").mapInArrow(run, "h1 long, h2 long, g1 long, g2 long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """Per document: n_lines, n_kept, n_links of its lines to different lines, and the numbers of the lines that stay."""
    lines = stage(line_keys(docs, id_col, text_col, tau).withColumn("line_id", F.monotonically_increasing_id()), "lines")
    found = stage(links(docs, lines, id_col, text_col, tau), "links")
    first = F.min(F.struct("doc_id", "line_no", "line_id")).alias("first")
    groups = lines.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("copies"))
    ends = found.select("h1", "h2").union(found.select("g1", "g2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_links"))
    special = groups.join(ends, ["h1", "h2"], "left").where("copies > 1 OR n_links IS NOT NULL")
    special = stage(special.select("h1", "h2", "first", F.col("first.line_id").alias("node"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "special")

    linked = special.where("n_links > 0")
    edges = found.join(linked.select("h1", "h2", F.col("node").alias("u")), ["h1", "h2"]).join(linked.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("node").alias("v")), ["g1", "g2"])
    root = components(edges.select("u", "v"))
    placed = special.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    placed = stage(placed.join(least, "root").select("h1", "h2", "n_links", F.col("least.line_id").alias("stays")), "placed")

    marked = lines.select("rid", "doc_id", "line_no", "line_id", "h1", "h2").join(bounded(placed, placed.count()), ["h1", "h2"], "left")
    kept = F.col("stays").isNull() | (F.col("stays") == F.col("line_id"))
    by_doc = marked.groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.array_sort(F.collect_list(F.when(kept, F.col("line_no")))).alias("kept"), F.min("doc_id").alias("doc_id")
    )
    none = _picked(docs, id_col, text_col).where(F.regexp_replace("text", "\n", "") == "").select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_kept"), F.lit(0).cast("long").alias("n_links"), F.array().cast("array<int>").alias("kept"))
    return by_doc.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), "n_links", "kept").union(none)


def cleaned(text: str, kept: list[int]) -> str:
    """A text with only its empty lines and those that stay."""
    stays = set(kept)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if not x or i in stays)


def op2_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents."""
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_segment_edit_join": op2_segment_edit_join}
SQL: dict[str, str] = {}
