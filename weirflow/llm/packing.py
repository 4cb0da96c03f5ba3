"""Packing by minimum bin slack.

Documents are encoded and cut into full windows and a remainder. Remainders wait in a block as
a multiset of lengths. The largest one opens a window; a subset-sum table, one bitset of
reachable sums per kind of length, finds the waiting lengths that fill the window closest to
its capacity, and going back through the table gives how many of each were used. A window that
comes out full is written. Others wait for lengths that are still to come; once half a block
waits, their closest fill is written too, and the slack it leaves is closed by a piece cut off
the largest waiting remainder, whose rest waits on. So each window but a task's last few comes
from the table, at most one document is cut a window, and no more than a block ever waits.

Of each task less than a window is left. These leftovers are packed in a second round, in which
a task takes those of ``TOGETHER`` tasks of the first; what is left of that is cut into powers
of two, so no sequence needs padding. A block is bounded in tokens and nothing goes through the
driver, so the work grows with the input only. Sequence ids are unique, not gapless: the task's
number in the upper bits, the second round's above them.

Defined results for odd input: a null or empty text is its end id alone; null ids are carried
along; equal rows are packed one by one; an empty table gives an empty result. Very long texts
are cut into windows. Only the id and text columns are read, whatever others are called.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage, table
from .vocab import fragments, spread

CAPACITY = 2048
END_ID = 1
#: Tokens that wait in a block before it is packed.
BLOCK = 1 << 21
#: Tasks' numbers stand above this many bits of a sequence id, the second round's mark above those.
BITS, SECOND = 40, 1 << 62
#: Tasks of the first round whose leftovers a task of the second one takes.
TOGETHER = 64

Piece = tuple[int | None, int, np.ndarray, int]


def fill(counts: dict[int, int], lengths: list[int], room: int) -> tuple[int, list[int]]:
    """The multiset of waiting lengths with the sum closest to ``room``, and that sum.

    ``lengths`` are the waiting lengths in falling order. A length with n copies enters as
    1, 2, 4 ... copies at once, so that every number of copies up to n can be reached. The
    table ends as soon as ``room`` itself is reachable.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        if size > room:
            continue
        left, some = min(counts[size], room // size), 1
        while left > 0:
            take = min(some, left)
            steps.append((reach, size, take))
            reach = (reach | reach << (size * take)) & mask
            left -= take
            some *= 2
        if reach >> room & 1:
            break
    best = total = reach.bit_length() - 1
    used: list[int] = []
    for before, size, take in reversed(steps):
        if not before >> total & 1:
            used += [size] * take
            total -= size * take
    return best, used


class Packer:
    """Packs the documents of one task; ``put`` and ``end`` return finished sequences."""

    def __init__(self, capacity: int = CAPACITY, block: int = BLOCK):
        self.capacity, self.block = capacity, max(block, 2 * capacity)
        self.waiting: dict[int, list[Piece]] = defaultdict(list)
        self.held = 0

    def wait(self, piece: Piece) -> None:
        self.waiting[len(piece[2])].append(piece)
        self.held += len(piece[2])

    def put(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, full = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            yield [(doc_id, at, ids[at : at + self.capacity], n)]
        if full < n:
            self.wait((doc_id, full, ids[full:], n))
        if self.held >= self.block:
            yield from self.pack(self.block // 2)

    def pack(self, most: int) -> Iterator[list[Piece]]:
        """Full windows; then closest fills closed by a cut, until no more than ``most`` tokens, or
        less than a window, wait."""
        counts = {k: len(v) for k, v in self.waiting.items() if v}
        lengths = sorted(counts, reverse=True)
        while lengths:
            root = lengths[0]
            counts[root] -= 1
            best, used = fill(counts, lengths, self.capacity - root)
            if best == self.capacity - root:
                for size in used:
                    counts[size] -= 1
                yield self._taken([root, *used])
            else:
                counts[root] = 0  # other copies find no better company
            if any(not counts[size] for size in [root, *used]):
                lengths = [size for size in lengths if counts[size]]
        counts = {k: len(v) for k, v in self.waiting.items() if v}
        while self.held > max(most, self.capacity - 1):
            lengths = sorted(counts, reverse=True)
            root = lengths[0]
            counts[root] -= 1
            best, used = fill(counts, [x for x in lengths if counts[x]], self.capacity - root)
            for size in used:
                counts[size] -= 1
            window, slack = self._taken([root, *used]), self.capacity - root - best
            if slack:
                # all that still waits is longer than the slack, or the fill would be closer
                size = max(k for k, n in counts.items() if n)
                doc_id, start, ids, n = self._taken([size])[0]
                window.append((doc_id, start, ids[:slack], n))
                self.wait((doc_id, start + slack, ids[slack:], n))
                counts[size] -= 1
                counts[size - slack] = counts.get(size - slack, 0) + 1
            counts = {k: n for k, n in counts.items() if n}
            yield window
        self.waiting = defaultdict(list, {k: v for k, v in self.waiting.items() if v})

    def _taken(self, sizes: list[int]) -> list[Piece]:
        self.held -= sum(sizes)
        return [self.waiting[size].pop() for size in sizes]

    def rest(self) -> list[Piece]:
        """What is left, less than a window, after ``pack(0)``."""
        out = [p for size in sorted(self.waiting, reverse=True) for p in self.waiting[size]]
        self.waiting, self.held = defaultdict(list), 0
        return out

    def end(self) -> Iterator[list[Piece]]:
        """The last windows, then what is left, cut into powers of two."""
        yield from self.pack(0)
        rest = self.rest()
        left = sum(len(p[2]) for p in rest)
        at = 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out: list[Piece] = []
            while room:
                doc_id, start, ids, n = rest[at]
                out.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest[at] = (doc_id, start + room, ids[room:], n)
                else:
                    at += 1
                room -= len(out[-1][2])
            yield out


class Rows:
    """Collects sequences as rows, with ids or their checksum; leftovers always with ids."""

    def __init__(self, task: int, checksum_only: bool):
        self.number, self.checksum_only = task, checksum_only
        self.rows: list[tuple] = []

    def add(self, sequences: Iterator[list[Piece]]) -> None:
        for pieces in sequences:
            offset = 0
            for doc_id, start, ids, n in pieces:
                kept = None if self.checksum_only else ids.astype(np.int32)
                self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), kept, n, self.number, offset))
                offset += len(ids)
            self.number += 1

    def left(self, pieces: list[Piece]) -> None:
        self.rows += [(doc_id, start, len(ids), None, ids.astype(np.int32), n, None, None) for doc_id, start, ids, n in pieces]

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset"]
_KINDS = [pa.int64()] * 4 + [pa.list_(pa.int32())] + [pa.int64()] * 3
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", checksum_only: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids (or their CRC-32), doc_tokens, sequence_id, offset."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    vocab = spread(docs.sparkSession, path)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = fragments(vocab.value, False), Packer(capacity)
        out = Rows(TaskContext.get().partitionId() << BITS, checksum_only)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    out.add(packer.put(doc_id, np.append(ids, np.uint32(end_id))))
                if len(out.rows) > 2000:
                    yield out.flush()
        out.add(packer.pack(0))
        out.left(packer.rest())
        yield out.flush()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(capacity), Rows(SECOND | TaskContext.get().partitionId() << BITS, checksum_only)
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "ids", "doc_tokens")]
            for doc_id, start, ids, n in zip(*(c.to_pylist() for c in cols), strict=True):
                packer.wait((doc_id, start, np.array(ids, dtype=np.uint32), n))
            if packer.held >= packer.block:
                out.add(packer.pack(packer.block // 2))
                yield out.flush()
        out.add(packer.end())
        yield out.flush()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    begun = stage(picked.mapInArrow(first, _SCHEMA).withColumn("task", F.spark_partition_id()), "packed")
    left = begun.where("sequence_id IS NULL")
    tasks = left.agg(F.max("task")).first()[0]
    found = begun.where("sequence_id IS NOT NULL").drop("task")
    if tasks is not None:
        group = F.floor(F.col("task") / TOGETHER).cast("int")
        found = found.unionByName(left.repartition(tasks // TOGETHER + 1, group).drop("task").mapInArrow(second, _SCHEMA))
    return found.drop("ids" if checksum_only else "ids_crc32")


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), checksum_only=True)


QUERIES = {"op8_minimum_bin_slack": op8_minimum_bin_slack}
SQL: dict[str, str] = {}
