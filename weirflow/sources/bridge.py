"""The JSON-lines protocol as DataFrames: requests parsed and checked, results rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.identity import decimal_u64, hex_of

# Operations, and limits of one frame.
OPS = ("hello", "append", "head", "read", "follow")
MAX_FRAME = 1 << 20
MAX_PAYLOAD = 480 * 1024
MAX_PAGE_EVENTS = 256
MAX_TIMEOUT_MS = 30_000
SCHEMA = "v int, id string, op string, log string, cursor string, idempotency_key string, payload_hex string, max_events long, max_bytes long, timeout_ms long, require array<string>, _corrupt string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Frames end at a newline; a carriage return before it is dropped."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def extract_id(line: Column) -> Column:
    """the id of a frame, also of a broken one as far as it can be read."""
    return F.coalesce(F.get_json_object(line, "$.id"), F.nullif(F.regexp_extract(line, r'"id"\s*:\s*"([^"\\]*)"', 1), F.lit("")))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Each frame's fields and a status, ``ok`` or the code of its first fault.

    A bad frame is a row with a code, never an error that ends the job.
    """
    r = F.from_json(F.col(line), SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("r", r)
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    in_range = lambda c, cap: F.col(c).isNull() | F.col(c).between(1, cap)
    needs_log = F.col("r.op") != "hello"
    payload = F.col("r.payload_hex")
    status = (
        F.when(F.octet_length(line) > MAX_FRAME, "frame_too_large")
        .when(bad, "invalid_json")
        .when(~checks.valid_request_id(F.col("r.id")) | (F.coalesce(F.col("r.v"), F.lit(0)) != 1), "invalid_request")
        .when(~F.coalesce(F.col("r.op").isin(*OPS), F.lit(False)), "unsupported")
        .when(needs_log & ~checks.valid_log_name(F.col("r.log")), "invalid_request")
        .when((F.col("r.op") == "append") & (~checks.valid_key_hex(F.col("r.idempotency_key")) | ~F.coalesce(payload.rlike("^(?:[0-9a-f]{2})+$"), F.lit(False))), "invalid_request")
        .when((F.col("r.op") == "append") & (F.length(payload) > 2 * MAX_PAYLOAD), "event_too_large")
        .when(F.col("r.op").isin("read", "follow") & ~checks.valid_cursor(F.col("r.cursor")), "invalid_request")
        .when(~in_range("r.max_events", MAX_PAGE_EVENTS) | ~in_range("r.max_bytes", MAX_PAYLOAD), "invalid_request")
        .when((F.col("r.op") == "follow") & ~F.coalesce(F.col("r.timeout_ms").between(0, MAX_TIMEOUT_MS), F.lit(True)), "invalid_request")
        .otherwise("ok")
    )
    out = rows.withColumn("id", F.coalesce("r.id", extract_id(F.col(line)))).withColumn("op", F.when(bad, None).otherwise(F.col("r.op"))).withColumn("status", status)
    return out.withColumn("cursor", decimal_u64(F.col("r.cursor")).try_cast("long")).withColumn("payload", F.unhex(payload)).withColumn("key", F.unhex("r.idempotency_key")).withColumn("log", F.col("r.log")).withColumn("max_events", F.col("r.max_events")).withColumn("max_bytes", F.col("r.max_bytes")).drop("r")


def wire(seq: Column, at: Column, payload: Column) -> list[Column]:
    """P10: a frame on the wire: decimal text, time with a zone, hexadecimal payload."""
    return [seq.cast("string").alias("seq"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), hex_of(payload.cast("binary")).alias("payload_hex")]


def respond(page: DataFrame) -> DataFrame:
    """A response line for each log's page."""
    event = F.struct(*wire(F.col("seq"), F.col("at"), F.col("payload")))
    body = page.groupBy("id", "log").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("k"), event.alias("e")))).alias("events"), F.max("seq").alias("last"))
    return body.select(F.to_json(F.struct(F.lit(1).alias("v"), "id", F.lit(True).alias("ok"), F.lit("read").alias("op"), "log", F.transform("events", lambda e: e["e"]).alias("events"), (F.col("last") + 1).cast("string").alias("next_cursor"))).alias("line"))


def sample_lines(events: DataFrame) -> DataFrame:
    """Requests made from events: appends, reads, and some with faults."""
    f = {"v": F.lit(1), "id": F.concat(F.lit("r"), F.col("event_id"))}
    made = lambda **more: F.to_json(F.struct(*(c.alias(k) for k, c in (f | more).items())))
    log = F.col("event_type")
    append = made(op=F.lit("append"), log=log, idempotency_key=F.concat(F.lit("0a"), F.lpad(F.col("user_id").cast("string"), 6, "0")), payload_hex=hex_of(F.col("props").cast("binary")))
    read = made(op=F.lit("read"), log=log, cursor=(F.col("event_id") + 1).cast("string"), max_events=F.col("event_id") % 300)
    zero = made(op=F.lit("read"), log=log, cursor=F.concat(F.lit("0"), F.col("event_id")))
    broken = F.concat(F.substring_index(made(op=F.lit("head")), "}", 1), F.lit(","))
    k = F.col("event_id") % 5
    return events.select("event_id", F.when(k == 4, broken).when(k == 3, zero).when(k == 2, read).when(k == 1, made(op=F.lit("drop"), log=log)).otherwise(append).alias("line"))
