"""Content-addressed objects as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import domain_hash, keyed_digest
from ..model import ObjectTooLarge


def put(blobs: DataFrame, key: bytes, payload: str, order: str) -> DataFrame:
    """Per digest the first row that brings it, how many bring it, and its size. Payloads
    don't travel: they are hashed where they are read."""
    data = F.col(payload).cast("binary")
    return blobs.select(keyed_digest(key, data).alias("digest"), F.col(order), F.octet_length(data).cast("long").alias("n_bytes")).groupBy("digest").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))


def new_only(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """What isn't stored yet; the rest are repeats."""
    return blobs.join(stored.select("digest"), "digest", "left_anti")


def put_object(blobs: DataFrame, key: bytes, tenant: str, kind: str, schema: str, payload: str, order: str, cap: int) -> DataFrame:
    """Typed objects in their envelopes, one of each digest. The type is part of what is
    digested, so equal bytes of two types are two objects; what is beyond ``cap`` is refused."""
    data = F.col(payload).cast("binary")
    size = F.octet_length(data).cast("long")
    digest = domain_hash(key, "object", F.lit(kind).cast("binary"), F.lit(schema).cast("binary"), data)
    each = blobs.select(F.when(size <= cap, digest).alias("digest"), F.col(order), size.alias("plaintext_bytes"))
    stored = each.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("plaintext_bytes").alias("plaintext_bytes"))
    return stored.select(F.lit(tenant).alias("tenant"), F.lit(kind).alias("kind"), F.lit(schema).alias("schema"), "digest", "first_id", "copies", "plaintext_bytes")


def decodable(objects: DataFrame, tenant: str, types: list[tuple[str, str]], cap: int) -> DataFrame:
    """The verdict on envelopes (tenant, kind, schema, plaintext_bytes) before a payload is
    opened: whose it is, whether the reader knows kind and schema, and the size, in this order."""
    known = F.lit(False)
    for kind, schema in types:
        known = known | ((F.col("kind") == kind) & (F.col("schema") == schema))
    foreign, unknown = ~F.col("tenant").eqNullSafe(F.lit(tenant)), ~F.col("kind").isin(*{k for k, _ in types})
    verdict = F.when(foreign, "tenant_mismatch").when(unknown, "unknown_kind").when(~known, "unknown_schema").when(F.col("plaintext_bytes") > cap, "too_large").otherwise("ok")
    return objects.withColumn("verdict", verdict)


def verify(objects: DataFrame, key: bytes, cap: int | None = None) -> DataFrame:
    """The verdict on each stored object (digest, payload, plaintext_bytes), in
    the order in which a reader must look: size cap, stated size, digest."""
    data = F.col("payload").cast("binary")
    size = F.octet_length(data).cast("long")
    verdict = F.when(F.lit(False) if cap is None else size > cap, "too_large").when(size != F.col("plaintext_bytes"), "size_mismatch").when(keyed_digest(key, data) != F.col("digest"), "digest_mismatch").otherwise("ok")
    return objects.withColumn("verdict", verdict)


def get(objects: DataFrame, digest: str | Column) -> DataFrame:
    """A lookup by digest, pushed down to the scan."""
    return objects.where(F.col("digest") == digest)


def write(objects: DataFrame, path: str) -> None:
    """The object table, fanned out by the digest's first two digits."""
    objects.withColumn("fan", F.substring(F.substring_index("digest", ":", -1), 1, 2)).write.mode("append").partitionBy("fan").parquet(path)


def import_files(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Files as payloads, with where and when they were found."""
    files = spark.read.format("binaryFile").load(path)
    if cap is not None and not files.drop("content").where(F.col("length") > cap).isEmpty():
        raise ObjectTooLarge(f"a file under {path} has more than {cap} bytes")
    return files.select(F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("plaintext_bytes"), F.col("content").alias("payload"))


def pieces(files: DataFrame, text: str, size: int = 1000) -> DataFrame:
    """A row for each piece of ``size`` characters of a text, with its number and digest; an empty text has one."""
    count = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size)
    rows = files.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count)))
    part = F.substring(F.col(text), (F.col("piece") * size + 1).cast("int"), F.lit(size))
    return rows.withColumn("digest", F.sha2(part.cast("binary"), 256))
