"""Exact dedup with composable polynomial fingerprints.

A text is hashed in chunks of ``CHUNK`` bytes, all chunks of a batch at once as a matrix
product; the chunk hashes combine by length-shifted arithmetic, ``h(ab) = h(a) * r**len(b) +
h(b)``, so a huge document is hashed piece by piece and the pieces could be hashed anywhere.
Texts of equal fingerprint and length are then compared chunk by chunk: per fingerprint and
chunk number the least and the greatest chunk must be the same bytes. Both are summed up
before the shuffle, so a group of any size sends one chunk per task and number.

Texts are equal when identical after lower-casing A-Z. Defined results for odd input: a null
text counts as empty, and empty texts are equal to each other. Of equal texts the row with
the largest id stays; a null id is smaller than any other, and of several rows with the
largest id one stays. An empty table gives an empty result. Only the id and text columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import discard, handed_on, stage, table

CHUNK = 512
#: Primes below 2**31, and a base for each: fixed values.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1299709411, 1500450271, 1020379033)
#: Bytes hashed at a time.
SLICE = 1 << 21
#: Bytes of a chunk in the comparison.
COMPARED = 1 << 16
#: Rows of a broadcast side at most; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


class Fingerprint:
    """Polynomial hashes of byte strings modulo several primes."""

    def __init__(self, moduli: tuple[int, ...] = MODULI, bases: tuple[int, ...] = BASES):
        self.moduli, self.bases = moduli, bases[: len(moduli)]
        rows = [[pow(r, CHUNK - 1 - i, p) for i in range(CHUNK)] for p, r in zip(self.moduli, self.bases, strict=True)]
        # a byte times a residue, summed over a chunk, is below 2**53: exact as doubles
        self.powers = np.array(rows, dtype=np.float64).T.copy()
        self.mod = np.array(self.moduli, dtype=np.uint64)

    def chunks(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all chunks of all strings, and the first chunk of each string.

        A string is padded in front with zero bytes, which add nothing to its hash.
        """
        n = np.array([max(1, -(-len(d) // CHUNK)) for d in data], dtype=np.int64)
        joined = b"".join(b"\0" * (int(k) * CHUNK - len(d)) + d for d, k in zip(data, n, strict=True))
        matrix = np.frombuffer(joined, dtype=np.uint8).reshape(-1, CHUNK).astype(np.float64)
        return (matrix @ self.powers).astype(np.uint64) % self.mod, np.concatenate(([0], np.cumsum(n)[:-1]))

    def many(self, data: list[bytes]) -> list[tuple[int, ...]]:
        """One hash tuple for each string; together they should hold about SLICE bytes."""
        if not data:
            return []
        hashes, first = self.chunks(data)
        ends = np.append(first[1:], len(hashes))
        shift = np.repeat(ends, ends - first) - 1 - np.arange(len(hashes))
        out = np.empty((len(data), len(self.moduli)), dtype=np.uint64)
        for k, (p, r) in enumerate(zip(self.moduli, self.bases, strict=True)):
            steps = np.ones(int(shift.max()) + 1, dtype=np.uint64)
            step = pow(r, CHUNK, p)
            for i in range(1, len(steps)):
                steps[i] = int(steps[i - 1]) * step % p
            out[:, k] = np.add.reduceat(hashes[:, k] * steps[shift] % np.uint64(p), first) % np.uint64(p)
        return [tuple(map(int, x)) for x in out]

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_len: int) -> tuple[int, ...]:
        """The hash of two strings put together, from theirs and the second one's length."""
        return tuple((a * pow(r, right_len, p) + b) % p for a, b, p, r in zip(left, right, self.moduli, self.bases, strict=True))

    def huge(self, data: bytes) -> tuple[int, ...]:
        total = (0,) * len(self.moduli)
        for i in range(0, len(data), SLICE):
            piece = data[i : i + SLICE]
            total = self.combine(total, self.many([piece])[0], len(piece))
        return total

    def all(self, data: list[bytes]) -> list[bytes]:
        """The fingerprint of each string as bytes, in bounded memory."""
        out: list[tuple[int, ...]] = []
        batch: list[bytes] = []
        held = 0
        for d in data:
            if len(d) > SLICE:
                out += self.many(batch)
                batch, held = [], 0
                out.append(self.huge(d))
                continue
            if held + len(d) > SLICE:
                out += self.many(batch)
                batch, held = [], 0
            batch.append(d)
            held += len(d)
        out += self.many(batch)
        return [b"".join(x.to_bytes(4, "big") for x in h) for h in out]


def normalised(text: str | None) -> bytes:
    """Lower-cases A-Z only, as bytes.lower() does."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def _texts(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    rid = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rid.alias("rid"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, ...] = MODULI, with_text: bool = False, row_col: str | None = None) -> DataFrame:
    """Per row: id, its number, fingerprint, length in bytes, SHA-256 of the normalised text, and that text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = Fingerprint(moduli)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                data = [normalised(x) for x in part.column(1).to_pylist()]
                cols = [part.column(0), part.column(2), pa.array(fp.all(data), pa.binary()), pa.array([len(d) for d in data], pa.int64())]
                cols.append(pa.array(data, pa.binary()) if with_text else pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "fp", "n_bytes", "body" if with_text else "text_sha256"])

    return _texts(docs, id_col, text_col, row_col).mapInArrow(run, f"doc_id long, rid long, fp binary, n_bytes long, {'body binary' if with_text else 'text_sha256 string'}")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has few enough rows; else the join shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def differing(docs: DataFrame, groups: DataFrame, n_groups: int, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, ...] = MODULI) -> DataFrame:
    """The fingerprints among ``groups`` (fp, n_bytes) whose texts are not all the same bytes."""
    bodies = fingerprints(docs, id_col, text_col, moduli, with_text=True).join(bounded(groups, n_groups), ["fp", "n_bytes"], "left_semi")
    count = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / COMPARED)).cast("int")
    chunks = bodies.select("fp", "n_bytes", "body", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    chunks = chunks.select("fp", "n_bytes", "chunk_no", F.expr(f"substring(body, chunk_no * {COMPARED} + 1, {COMPARED})").alias("chunk"))
    same = chunks.groupBy("fp", "n_bytes", "chunk_no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return same.where("lo <> hi").select("fp", "n_bytes").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, ...] = MODULI, row_col: str | None = None) -> DataFrame:
    """Every row with the id that stays for its text, its group's size, and whether it is the row that stays.

    ``row_col`` names a column that numbers the rows; it comes back as ``rid``.
    """
    rows = stage(fingerprints(docs, id_col, text_col, moduli, row_col=row_col), "fingerprints")

    def repeats(rows: DataFrame) -> DataFrame:
        groups = rows.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep"))
        return stage(groups.where("group_size > 1"), "groups")

    repeated = repeats(rows)
    unlike = stage(differing(docs, repeated.select("fp", "n_bytes"), repeated.count(), id_col, text_col, moduli), "unlike")
    if not unlike.isEmpty():
        # texts that only share a fingerprint: their rows are told apart by digest
        marked = unlike.withColumn("clash", F.lit(True))
        discard(repeated)
        rows = handed_on(rows.join(bounded(marked, unlike.count()), ["fp", "n_bytes"], "left").withColumn("fp", F.when(F.col("clash"), F.unhex("text_sha256")).otherwise(F.col("fp"))).drop("clash"), rows, unlike)
        repeated = repeats(rows)
    joined = rows.join(bounded(repeated, repeated.count()), ["fp", "n_bytes"], "left")
    alone = F.col("group_size").isNull()
    out = joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        "text_sha256",
        "rid",
    )
    return handed_on(out, rows, repeated)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return without_rows(docs, lambda numbered, row: classes(numbered, id_col, text_col, row_col=row))


def without_rows(docs: DataFrame, find: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` without the rows that ``find``, given them with a numbering column, returns as not kept."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = find(numbered, row)
    gone = stage(found.where("NOT kept").select(F.col("rid").alias(row)), "gone")
    discard(found)
    return handed_on(numbered.join(bounded(gone, gone.count()), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)), numbered, gone)


def op6_polynomial_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return classes(table(spark, sf_dir, "documents")).drop("rid")


QUERIES = {"op6_polynomial_fingerprints": op6_polynomial_fingerprints}
SQL = {
    "op6_polynomial_fingerprints": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
}
