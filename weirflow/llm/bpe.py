"""BPE encoding and decoding with forced-boundary splitting.

Byte pairs that occur inside no vocabulary token mark places no merge can cross (see
``vocab.Fragments``). Texts are cut there, each distinct fragment is encoded once, and the ids
are put together; the result is that of encoding the whole text.

Defined results for odd input: a null text counts as empty and has no ids; a text that holds a
special token's string is encoded whole, as the library does; equal rows each get their own
result; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import table
from .vocab import fragments, gather, spread


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the ids of its text."""
    vocab = spread(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = fragments(vocab.value, True)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(np.int32) for i in enc.encode(part.column(1).to_pylist())], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): the text of the ids, special tokens included; null ids give null."""
    vocab = spread(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = fragments(vocab.value, True)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if i is None else enc.decode(np.array(i, dtype=np.int64)) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them.

    Encodes and decodes in one pass, so that ids needn't travel between the worker and the JVM.
    """
    vocab = spread(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = fragments(vocab.value, True)
        said = [f"{i}," for i in range(len(enc.tokens))]
        blob, sizes = np.frombuffer("".join(said).encode(), dtype=np.uint8), np.array([len(x) for x in said])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, ids_sha, text_sha = [], [], []
                for ids in enc.encode(part.column(1).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(gather(blob, sizes, ids)[:-1]).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op3_forced_boundary_bpe": op3_forced_boundary_bpe}
SQL: dict[str, str] = {}
