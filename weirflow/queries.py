"""The engine's operators applied to the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks, identity
from .operators import catalog, feed, folds, history, holdings, idempotency, measure, paging, reach
from .sources import blobs
from .sources.shared import own_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = b"a tenant's secret key of any size"
_IN, _OUT = (x.hex() for x in identity.pads(KEY))
NOW = "2024-01-20 00:00:00"


def _hmac(data: str) -> str:
    """DuckDB: our keyed digest of a blob expression."""
    return f"('{identity.TAG}:' || sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || {data}))))"


def _u64(n: str) -> str:
    return f"unhex(lpad(to_hex(CAST({n} AS BIGINT)), 16, '0'))"


def _framed(x: str) -> str:
    return f"({_u64(f'octet_length({x})')} || {x})"


def _domain(name: str, *fields: str) -> str:
    return _hmac(" || ".join([_framed(f"encode('{name}')"), _u64(str(len(fields))), *map(_framed, fields)]))


# Shared relations of the SQL side.
_LOG = """log AS (SELECT event_type AS log, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, ts AS "at", props AS payload,
    CAST(octet_length(encode(props)) AS BIGINT) AS n_bytes, event_id, user_id FROM events)"""
_CHUNK = f"""{_LOG}, chunk AS (SELECT log, (seq - 1) // 64 AS chunk, min(seq) AS first, max(seq) AS last, count(*) AS event_count,
    CAST(sum(n_bytes) AS BIGINT) AS n_bytes, max("at") AS last_at FROM log GROUP BY ALL)"""
_KEYED = """keyed AS (SELECT event_type AS log, user_id || ':' || event_id % 7 AS sk, props AS payload, ts, event_id FROM events),
    nth AS (SELECT *, row_number() OVER (PARTITION BY log, sk ORDER BY ts, event_id) AS nth FROM keyed),
    firsts AS (SELECT log, sk, payload AS first_payload, event_id AS first_event, row_number() OVER (PARTITION BY log ORDER BY ts, event_id) AS seq FROM nth WHERE nth = 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def day(ts: str = "ts") -> Column:
    return F.to_date(ts)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG: events as frames, a log for each type."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("log"), F.col("ts").alias("at"), F.col("props").alias("payload"), F.octet_length("props").cast("long").alias("n_bytes"), "event_id", "user_id")
    return feed.assign_seq(rows, "log", ["at", "event_id"], day("at"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.chunks(log(spark, sf_dir))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("log"), F.concat_ws(":", "user_id", F.col("event_id") % 7).alias("sk"), F.col("props").alias("payload"), "ts", "event_id")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Numbering and reading


@query(f'WITH {_LOG} SELECT log, seq, "at", payload, n_bytes FROM log')
def append_assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("log", "seq", "at", "payload", "n_bytes")


@query("""SELECT event_type AS log, event_id, 1 + event_id % 3 AS n,
    CAST(sum(1 + event_id % 3) OVER w AS BIGINT) - (1 + event_id % 3) + 1 AS first, CAST(sum(1 + event_id % 3) OVER w AS BIGINT) AS last
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def append_assign_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_type").alias("log"), "ts", "event_id")
    return feed.assign_ranges(rows, "log", ["ts", "event_id"], day(), 1 + F.col("event_id") % 3).select("log", "event_id", "n", "first", "last")


@query("""SELECT user_id, count(*) AS n_events, CAST(sum(octet_length(encode(props))) AS BIGINT) AS n_bytes,
    CASE WHEN count(*) > 12 THEN 'too_many' WHEN sum(octet_length(encode(props))) > 90 THEN 'too_large' ELSE 'ok' END AS status FROM events GROUP BY user_id""")
def append_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.octet_length("props")).alias("n_bytes"))
    return batch.withColumn("status", checks.admission(F.col("n_events"), F.col("n_bytes"), 12, 90))


@query(f'WITH {_LOG} SELECT log, seq, "at", payload FROM log WHERE seq >= 10 AND seq > 24')
def log_read_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.read_from(log(spark, sf_dir), 10, 24).select("log", "seq", "at", "payload")


@query(f"""WITH {_LOG}, named AS (SELECT DISTINCT log FROM log UNION ALL SELECT 'absent')
    SELECT n.log, coalesce(max(l.seq), 0) AS head_seq, coalesce(max(l.seq), 0) + 1 AS next_seq FROM named n LEFT JOIN log l ON n.log = l.log GROUP BY n.log""")
def log_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = events(spark, sf_dir).select(F.col("event_type").alias("log")).distinct().union(spark.range(1).select(F.lit("absent")))
    return feed.head_of(log(spark, sf_dir), named)


@query(f"WITH {_CHUNK} SELECT log, max(last) AS head_seq, count(*) AS n_chunks, max(last_at) AS last_at FROM chunk GROUP BY log")
def log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.status(log(spark, sf_dir))


# Catalogue


@query(f"WITH {_CHUNK} SELECT * FROM chunk")
def chunk_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query(
    f"WITH {_CHUNK} "
    + " UNION ALL ".join(f"SELECT log, chunk // {4**k} AS node, min(first) AS first, max(last) AS last, count(*) AS chunk_count, {k} AS level FROM chunk GROUP BY log, chunk // {4**k}" for k in (1, 2, 3))
)
def catalog_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.levels(chunks(spark, sf_dir), 4, 3)


@query(f"""WITH {_CHUNK}, probe AS (SELECT event_type AS log, event_id, event_id * 7 % 3000 AS seq FROM events)
    SELECT p.log, p.event_id, p.seq, c.chunk, c.first, c.last FROM probe p LEFT JOIN chunk c ON p.log = c.log AND p.seq BETWEEN c.first AND c.last""")
def catalog_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = events(spark, sf_dir).select(F.col("event_type").alias("log"), "event_id", (F.col("event_id") * 7 % 3000).alias("seq"))
    return catalog.seek(chunks(spark, sf_dir), probes)


@query(f"""WITH {_CHUNK}, kept AS (SELECT * FROM chunk WHERE chunk % 7 <> 3)
    SELECT log, chunk, first, coalesce(lag(last) OVER (PARTITION BY log ORDER BY first), 0) + 1 AS expected,
    coalesce(lag(last) OVER (PARTITION BY log ORDER BY first), 0) + 1 = first AS contiguous FROM kept""")
def catalog_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.contiguity(chunks(spark, sf_dir).where("chunk % 7 <> 3")).select("log", "chunk", "first", "expected", "contiguous")


@query(f"WITH {_CHUNK} SELECT log, chunk, chunk % 5 <> 0 AS ok FROM chunk")
def chunk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = log(spark, sf_dir)
    stored = feed.chunks(frames).withColumn("n_bytes", F.col("n_bytes") + F.when(F.col("chunk") % 5 == 0, 1).otherwise(0))
    return catalog.integrity(stored, frames)


@query(f"""WITH {_LOG}, kept AS (SELECT log, seq, lag(seq, 1, 0) OVER (PARTITION BY log ORDER BY seq) AS after_seq FROM log WHERE seq % 97 <> 0)
    SELECT log, after_seq, seq FROM kept WHERE after_seq + 1 <> seq""")
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.gaps(log(spark, sf_dir).where("seq % 97 <> 0"))


# Pages


def _page_sql(cursor: str, events_cap: int, bytes_cap: int, trim: str) -> str:
    return f"""WITH {_LOG}, cur AS (SELECT log, max(seq) AS head_seq, {cursor} AS cursor, {trim} AS trim FROM log GROUP BY log),
    run AS (SELECT l.log, l.n_bytes, sum(l.n_bytes) OVER (PARTITION BY l.log ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY l.log ORDER BY seq) AS nth
            FROM log l JOIN cur c ON l.log = c.log WHERE l.seq >= c.cursor AND l.seq > c.trim AND c.cursor >= 1),
    page AS (SELECT log, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS b FROM run WHERE nth <= {events_cap} AND upto <= {bytes_cap} GROUP BY log),
    s AS (SELECT c.*, coalesce(n, 0) AS n_events, coalesce(b, 0) AS n_bytes,
          CASE WHEN cursor < 1 OR cursor > head_seq + 1 THEN 'invalid_cursor' WHEN cursor <= trim THEN 'trimmed' WHEN coalesce(n, 0) = 0 AND cursor <= head_seq THEN 'event_too_large' ELSE 'ok' END AS status
          FROM cur c LEFT JOIN page p ON c.log = p.log)
    SELECT log, status, n_events, n_bytes, cursor + n_events AS next_seq, status = 'ok' AND cursor + n_events = head_seq + 1 AS at_head"""


def _cursors(frames: DataFrame, cursor: Column, trim: Column) -> DataFrame:
    return frames.groupBy("log").agg(F.max("seq").alias("head_seq")).withColumn("cursor", cursor).withColumn("trim", trim.cast("long"))


_CURSOR = "CASE log WHEN 'click' THEN 5 WHEN 'view' THEN 9 WHEN 'error' THEN {head} + 2 WHEN 'signup' THEN {head} - 3 ELSE 1 END"
_TRIM = "CASE log WHEN 'view' THEN 20 ELSE 0 END"


@query(_page_sql(f"CAST({_CURSOR.format(head='max(seq)')} AS BIGINT)", 256, 2000, _TRIM) + " FROM s")
def read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = log(spark, sf_dir)
    at = _cursors(frames, F.expr(_CURSOR.format(head="head_seq")).cast("long"), F.expr(_TRIM))
    return paging.page_summary(frames, at, 256, 2000).select("log", "status", "n_events", "n_bytes", "next_seq", "at_head")


_TAIL = "CASE log WHEN 'click' THEN {head} - 3 ELSE {head} + 1 END"


@query(_page_sql(f"CAST({_TAIL.format(head='max(seq)')} AS BIGINT)", 256, 2000, "0") + ", status = 'ok' AND n_events = 0 AND cursor = head_seq + 1 AS timed_out FROM s")
def follow_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = log(spark, sf_dir)
    at = _cursors(frames, F.expr(_TAIL.format(head="head_seq")).cast("long"), F.lit(0))
    return paging.page_summary(frames, at, 256, 2000).select("log", "status", "n_events", "n_bytes", "next_seq", "at_head", "timed_out")


@query(f"""WITH RECURSIVE {_LOG}, walk AS (
    SELECT log, seq, n_bytes AS held, 1 AS n, CAST(1 AS BIGINT) AS page FROM log WHERE seq = 1
    UNION ALL SELECT l.log, l.seq, CASE WHEN w.n + 1 > 100 OR w.held + l.n_bytes > 900 THEN l.n_bytes ELSE w.held + l.n_bytes END,
      CASE WHEN w.n + 1 > 100 OR w.held + l.n_bytes > 900 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n + 1 > 100 OR w.held + l.n_bytes > 900 THEN w.page + 1 ELSE w.page END
    FROM walk w JOIN log l ON l.log = w.log AND l.seq = w.seq + 1)
    SELECT log, seq, page FROM walk""")
def paginate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.paginate(log(spark, sf_dir).select("log", "seq", "n_bytes"), 100, 900).select("log", "seq", "page")


# Group commit


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select(F.col("event_type").alias("log"), at.alias("at_us"), "event_id", (1 + F.col("event_id") % 2).alias("n"), (F.col("user_id") % 50).alias("id"), F.col("props").alias("payload"), "ts")


@query("""WITH RECURSIVE s AS (SELECT event_type AS log, epoch_us(ts) AS at_us, event_id, 1 + event_id % 2 AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT log, k, event_id, at_us AS opened, n AS held, CAST(1 AS BIGINT) AS batch FROM s WHERE k = 1
    UNION ALL SELECT s.log, s.k, s.event_id, CASE WHEN s.at_us >= w.opened + 10800000000 OR w.held >= 8 THEN s.at_us ELSE w.opened END,
      CASE WHEN s.at_us >= w.opened + 10800000000 OR w.held >= 8 THEN s.n ELSE w.held + s.n END, CASE WHEN s.at_us >= w.opened + 10800000000 OR w.held >= 8 THEN w.batch + 1 ELSE w.batch END
    FROM walk w JOIN s ON s.log = w.log AND s.k = w.k + 1)
    SELECT log, event_id, batch FROM walk""")
def group_commit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_commits(submissions(spark, sf_dir).select("log", "at_us", "event_id", "n"), 3 * 3600 * 1_000_000, 8).select("log", "event_id", "batch")


_DEDUP = """s AS (SELECT event_type AS log, CAST(ts AS DATE) AS batch, user_id % 50 AS id, props AS payload, ts, event_id FROM events),
    d AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN first_value(payload) OVER w = payload THEN 'shared' ELSE 'conflict' END AS status
          FROM s WINDOW w AS (PARTITION BY log, batch, id ORDER BY ts, event_id))"""


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idempotency.group_dedup(submissions(spark, sf_dir).withColumn("batch", day()), ["log", "batch"], "id", ["ts", "event_id"])


@query(f"WITH {_DEDUP} SELECT log, batch, event_id, id, status FROM d")
def group_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select("log", "batch", "event_id", "id", "status")


@query(f"""WITH {_DEDUP}, a AS (SELECT DISTINCT log, batch, id, payload FROM d WHERE status = 'first')
    SELECT d.log, d.event_id, a.id IS NOT NULL AS acked FROM d LEFT JOIN a ON d.log = a.log AND d.batch = a.batch AND d.id = a.id AND d.payload = a.payload""")
def group_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deduped(spark, sf_dir)
    admitted = rows.where("status = 'first'").select("log", "batch", "id", "payload")
    return idempotency.acknowledgements(rows, admitted, ["log", "batch", "id", "payload"]).select("log", "event_id", "acked")


_STATS = """c AS (SELECT log, batch, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (WHERE status = 'first') AS events, count(*) FILTER (WHERE status = 'conflict') AS conflicts FROM d GROUP BY log, batch)"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s)
    return _deduped(spark, sf_dir).groupBy("log", "batch").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), one("first").alias("events"), one("conflict").alias("conflicts"))


@query(f"WITH {_DEDUP}, {_STATS} SELECT log, count(*) AS commits, CAST(sum(events) AS BIGINT) AS events, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM c GROUP BY log")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summary(_commits(spark, sf_dir), "log").select("log", "commits", "events", "conflicts")


@query(f"""WITH {_DEDUP}, {_STATS} SELECT log, CAST(sum(events) AS BIGINT) AS events, count(*) AS commits, CAST(sum(conflicts) AS BIGINT) AS conflicts, round(sum(events) / greatest(count(*), 1), 4) AS mean_batch,
    round(sum(events) / greatest((epoch_us(max(last_at)) - epoch_us(min(first_at))) / 1e6, 1e-6), 6) AS per_second FROM c GROUP BY log""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summary(_commits(spark, sf_dir), "log")


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n, max(value) FILTER (WHERE i = CAST(floor((n - 1) * 0.5) AS BIGINT)) AS p50, max(value) FILTER (WHERE i = CAST(floor((n - 1) * 0.99) AS BIGINT)) AS p99 FROM s GROUP BY event_type, n""")
def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.lower_ranks(events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p99": 0.99})


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def load_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.upper_ranks(events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p90": 0.9})


# Idempotency


@query(f"""WITH {_KEYED} SELECT n.log, n.sk, n.event_id, CASE WHEN nth = 1 THEN 'committed' WHEN n.payload = f.first_payload THEN 'retry' ELSE 'conflict' END AS status,
    CASE WHEN nth = 1 OR n.payload = f.first_payload THEN f.seq END AS seq FROM nth n JOIN firsts f ON n.log = f.log AND n.sk = f.sk""")
def stable_append_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idempotency.receipts(keyed(spark, sf_dir), "sk", "log", ["ts", "event_id"], day()).select("log", "sk", "event_id", "status", "seq")


@query(f"""WITH {_KEYED}, probe AS (SELECT DISTINCT event_type AS log, user_id || ':' || (event_id + 3) % 9 AS sk FROM events)
    SELECT p.log, p.sk, f.seq, f.seq IS NOT NULL AS found FROM probe p LEFT JOIN firsts f ON p.log = f.log AND p.sk = f.sk""")
def stable_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = idempotency.receipts(keyed(spark, sf_dir), "sk", "log", ["ts", "event_id"], day()).where("status = 'committed'").select("log", "sk", "seq")
    probes = events(spark, sf_dir).select(F.col("event_type").alias("log"), F.concat_ws(":", "user_id", (F.col("event_id") + 3) % 9).alias("sk")).distinct()
    return idempotency.lookup(committed, probes, ["log", "sk"]).withColumn("found", F.col("seq").isNotNull())


@query("""WITH h AS (SELECT event_id, sha256(encode(CAST(event_id AS VARCHAR))) AS h FROM events)
    SELECT event_id, """ + ", ".join(f"(CAST('0x' || substr(h || '00', {d * 5 // 4 + 1}, 3) AS INTEGER) >> {12 - 5 - d * 5 % 4}) & 31 AS n{d}" for d in (0, 1, 2, 3, 50, 51)) + " FROM h")
def index_nibbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.sha2(F.col("event_id").cast("string").cast("binary"), 256)
    return events(spark, sf_dir).select("event_id", *(identity.nibble(path, d).alias(f"n{d}") for d in (0, 1, 2, 3, 50, 51)))


@query(f"""WITH {_KEYED}, bad AS (SELECT log, sk, CASE WHEN seq % 11 = 1 THEN 0 ELSE seq END AS first, CASE WHEN seq % 11 = 2 THEN seq - 1 WHEN seq % 11 = 3 THEN seq + 1000000 ELSE seq END AS last,
    CASE WHEN seq % 11 = 4 THEN 0 ELSE 1 END AS generation FROM firsts),
    v AS (SELECT *, CASE WHEN first < 1 THEN 'first_below_one' WHEN last < first THEN 'last_before_first' WHEN generation < 1 OR generation > 5 THEN 'generation_out_of_range' WHEN last > 500000 THEN 'beyond_head' END AS violation FROM bad)
    SELECT log, sk, violation FROM v WHERE violation IS NOT NULL""")
def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    entries = idempotency.receipts(keyed(spark, sf_dir), "sk", "log", ["ts", "event_id"], day()).where("status = 'committed'").select(
        "log", "sk", F.when(seq % 11 == 1, 0).otherwise(seq).alias("first"), F.when(seq % 11 == 2, seq - 1).when(seq % 11 == 3, seq + 1000000).otherwise(seq).alias("last"), F.when(seq % 11 == 4, 0).otherwise(1).alias("generation")
    )
    return catalog.index_violations(entries, 500_000, 5).select("log", "sk", "violation")


@query(f"""SELECT event_id, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) < -120000000 THEN 'invalid' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) >= 604800000000 THEN 'unknown'
    WHEN event_id % 2 <> 0 AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 300000000 THEN 'unknown' ELSE 'ok' END AS status FROM events""")
def op_time_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", checks.time_gate(F.col("ts"), F.lit(NOW).cast("timestamp"), F.col("event_id") % 2 == 0).alias("status"))


@query(f"""WITH {_KEYED} SELECT n.event_id, CASE WHEN f.sk IS NULL THEN 'unknown' WHEN f.first_payload = n.payload THEN 'recovered' ELSE 'conflict' END AS outcome, f.seq
    FROM keyed n LEFT JOIN (SELECT * FROM firsts WHERE seq % 3 <> 0) f ON n.log = f.log AND n.sk = f.sk""")
def op_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select(F.concat_ws("/", "log", "sk").alias("identity"), F.col("payload").alias("request"), "event_id")
    admitted = idempotency.receipts(keyed(spark, sf_dir), "sk", "log", ["ts", "event_id"], day()).where("status = 'committed' AND seq % 3 <> 0")
    return idempotency.recover(rows, admitted.select(F.concat_ws("/", "log", "sk").alias("identity"), F.col("payload").alias("request"), "seq")).select("event_id", "outcome", "seq")


# Refs, leases, commits

_OPS = "CASE event_type WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'steal' WHEN 'view' THEN 'renew' WHEN 'click' THEN 'release' ELSE 'set' END"
_TTL = 6 * 3600 * 1_000_000
_LEASE = f"""o AS (SELECT user_id % 8 AS ref, user_id AS writer, {_OPS} AS op, epoch_us(ts) AS at_us, event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS k FROM events),
    walk AS (SELECT ref, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS epoch, CAST(NULL AS BIGINT) AS holder, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS at_us FROM (SELECT DISTINCT ref FROM o)
    UNION ALL SELECT n.ref, n.k, n.event_id, n.status,
      n.generation + CASE WHEN n.status = 'ok' AND n.op <> 'renew' THEN 1 ELSE 0 END, n.epoch + CASE WHEN n.status = 'ok' AND n.op IN ('claim', 'steal') THEN 1 ELSE 0 END,
      CASE WHEN n.status <> 'ok' THEN n.holder WHEN n.op IN ('claim', 'steal') THEN n.writer WHEN n.op = 'release' THEN NULL ELSE n.holder END,
      CASE WHEN n.status <> 'ok' THEN n.until WHEN n.op IN ('claim', 'steal', 'renew') THEN n.at_us + {_TTL} WHEN n.op = 'release' THEN 0 ELSE n.until END, n.at_us
    FROM (SELECT o.ref, o.k, o.event_id, o.op, o.writer, o.at_us, w.generation, w.epoch, w.holder, w.until,
      CASE WHEN op = 'claim' AND holder IS NOT NULL AND until > o.at_us AND holder <> writer THEN 'lease_held' WHEN op IN ('renew', 'release') AND holder IS NULL THEN 'no_lease'
           WHEN op = 'release' AND holder <> writer THEN 'rejected' WHEN op = 'set' AND holder IS NOT NULL AND until > o.at_us THEN 'lease_held' ELSE 'ok' END AS status
      FROM walk w JOIN o ON o.ref = w.ref AND o.k = w.k + 1) n)"""


def lease_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select((F.col("user_id") % 8).alias("ref"), F.col("user_id").alias("writer"), F.expr(_OPS).alias("op"), at.alias("at_us"), "event_id")


@query(f"WITH RECURSIVE {_LEASE} SELECT ref, event_id, status, generation, epoch FROM walk WHERE k > 0")
def lease_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.lease_machine(lease_ops(spark, sf_dir), _TTL).select("ref", "event_id", "status", "generation", "epoch")


@query(f"SELECT event_id, coalesce(CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 6 HOUR END > TIMESTAMP '{NOW}', false) AS live FROM events")
def lease_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 6 HOUR"))
    return events(spark, sf_dir).select("event_id", checks.lease_live(until, F.lit(NOW).cast("timestamp_ntz")).alias("live"))


_COMMITS = "commits AS (SELECT user_id % 8 AS ref, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS generation, props AS target, event_id, ts FROM events)"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("user_id") % 8).alias("ref"), F.col("props").alias("target"), "event_id", "ts")
    return feed.assign_seq(rows, "ref", ["ts", "event_id"], day(), "generation")


@query(f"WITH {_COMMITS}, h AS (SELECT ref, max(generation) AS g, max_by(target, generation) AS live FROM commits GROUP BY ref) SELECT c.ref, c.generation, c.target, h.live AS live_target FROM commits c JOIN h ON c.ref = h.ref WHERE c.generation > h.g - 5")
def ref_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(commits(spark, sf_dir), "ref", 5).select("ref", "generation", "target", "live_target")


@query(f"""WITH {_COMMITS}, s AS (SELECT ref, event_id, ts, CASE WHEN event_id % 41 = 0 THEN generation - 3 ELSE generation END AS generation, generation // 10 AS epoch FROM commits),
    l AS (SELECT *, lag(generation) OVER w AS generation_before, lag(epoch) OVER w AS epoch_before FROM s WINDOW w AS (PARTITION BY ref ORDER BY ts, event_id))
    SELECT ref, event_id, generation, generation_before FROM l WHERE generation < generation_before OR epoch < epoch_before""")
def ref_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = commits(spark, sf_dir).withColumn("epoch", F.floor(F.col("generation") / 10)).withColumn("generation", F.when(F.col("event_id") % 41 == 0, F.col("generation") - 3).otherwise(F.col("generation")))
    return history.regressions(seen, "ref", ["ts", "event_id"], day()).select("ref", "event_id", "generation", "generation_before")


@query(f"WITH {_COMMITS}, k AS (SELECT ref, generation, lag(generation, 1, 0) OVER (PARTITION BY ref ORDER BY generation) AS parent FROM commits WHERE event_id % 53 <> 0) SELECT ref, generation, parent FROM k WHERE parent + 1 <> generation")
def commit_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.breaks(commits(spark, sf_dir).where("event_id % 53 <> 0"), "ref").select("ref", "generation", "parent")


@query(f"""WITH {_COMMITS}, h AS (SELECT ref, max(generation) AS g, max_by(target, generation) AS t FROM commits WHERE ref <> 6 GROUP BY ref),
    r AS (SELECT ref, max(generation) + CASE WHEN ref = 1 THEN 1 ELSE 0 END AS g, CASE WHEN ref = 2 THEN 1 ELSE 0 END AS e, CASE WHEN ref = 3 THEN 'x' ELSE max_by(target, generation) END AS t FROM commits WHERE ref <> 7 GROUP BY ref)
    SELECT coalesce(r.ref, h.ref) AS ref, CASE WHEN h.ref IS NULL THEN 'no_commit' WHEN r.ref IS NULL THEN 'no_ref' WHEN r.g <> h.g THEN 'generation' WHEN r.e <> 0 THEN 'epoch' WHEN r.t <> h.t THEN 'target' ELSE 'ok' END AS finding
    FROM r FULL JOIN h ON r.ref = h.ref""")
def ref_commit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir).withColumn("epoch", F.lit(0))
    live = rows.where("ref <> 7").groupBy("ref").agg(F.max("generation").alias("g"), F.max_by("target", "generation").alias("t"))
    refs = live.select("ref", (F.col("g") + F.when(F.col("ref") == 1, 1).otherwise(0)).alias("generation"), F.when(F.col("ref") == 2, 1).otherwise(0).alias("epoch"), F.when(F.col("ref") == 3, "x").otherwise(F.col("t")).alias("target"))
    return history.consistency(refs, rows.where("ref <> 6"), "ref")


@query(f"WITH {_COMMITS} SELECT ref, generation, generation & -generation AS distance, generation - (generation & -generation) AS skip_to FROM commits")
def skip_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("generation")
    return commits(spark, sf_dir).select("ref", "generation", history.skip_distance(g).alias("distance"), history.skip_target(g).alias("skip_to"))


@query(f"WITH {_COMMITS} SELECT ref, generation, target FROM commits WHERE generation = 12")
def seek_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.at_generation(commits(spark, sf_dir), F.lit(12)).select("ref", "generation", "target")


@query(f"WITH {_LOG}, h AS (SELECT log, max(seq) AS head, greatest(0, least(CASE log WHEN 'click' THEN 10 WHEN 'view' THEN 99999999 ELSE 150 END, max(seq))) AS floor FROM log GROUP BY log) SELECT log, floor, head - floor AS surviving, floor + 1 AS resume_at FROM h")
def trim_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.trim(log(spark, sf_dir), F.expr("CAST(CASE log WHEN 'click' THEN 10 WHEN 'view' THEN 99999999 ELSE 150 END AS BIGINT)"))


def _feeds(spark: SparkSession, name: str):
    """Feeds under a folder of their own in the shared one."""
    from .plans.feeds import Feeds
    from .sources.commitlog import HadoopStore

    root = own_path(spark, name)
    return Feeds(spark, root, HadoopStore(spark, root))


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, in two feeds; event_id is the order."""
    return events(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("log"), F.col("props").cast("binary").alias("payload"), F.col("event_id").alias("_order"), "event_id")


_SUBMITTED = """sub AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS log, props AS payload, event_id FROM events),
    framed AS (SELECT log, row_number() OVER (PARTITION BY log ORDER BY event_id) AS seq, payload FROM sub)"""


@query(f"WITH {_SUBMITTED} SELECT log, CAST(3 AS BIGINT) AS merged, count(*) AS frames, CAST(0 AS BIGINT) AS changed FROM framed GROUP BY log")
def compact_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits of each feed, compacted; frames before and after are compared both ways."""
    feeds, rows, out = _feeds(spark, "compact"), _submitted(spark, sf_dir), None
    size = rows.agg(F.max("event_id")).first()[0] // 3 + 1
    for name in ("even", "odd"):
        for k in range(3):
            feeds.append(name, f"op{k}", "w", rows.where((F.col("log") == name) & (F.floor(F.col("event_id") / size) == k)), f"r{k}", 3600, limit=0)
        before = feeds.frames(name)
        merged = feeds.compact(name, "compact")
        after = feeds.frames(name)
        differ = before.exceptAll(after).unionAll(after.exceptAll(before)).agg(F.count(F.lit(1)).alias("changed"))
        one = after.agg(F.count(F.lit(1)).alias("frames")).withColumn("k", F.lit(1)).join(differ.withColumn("k", F.lit(1)), "k")
        one = one.select(F.lit(name).alias("log"), F.lit(merged).cast("long").alias("merged"), "frames", "changed")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"WITH {_SUBMITTED} SELECT log, count(*) AS frames, count(DISTINCT seq) AS numbers, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS n_bytes, CAST(1 AS BIGINT) AS segments, CAST(1 AS BIGINT) AS chunks FROM framed GROUP BY log")
def segments_union_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed read over its segment and the chunk that came after compaction."""
    feeds, rows, out = _feeds(spark, "segments"), _submitted(spark, sf_dir), None
    size = rows.agg(F.max("event_id")).first()[0] // 3 + 1
    for name in ("even", "odd"):
        for k in range(3):
            if k == 2:
                feeds.compact(name)
            feeds.append(name, f"op{k}", "w", rows.where((F.col("log") == name) & (F.floor(F.col("event_id") / size) == k)), f"r{k}", 3600, limit=0)
        kinds = [f["kind"] for f in feeds.files(feeds.ref(name))]
        one = feeds.read(name, 1).agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("seq").alias("numbers"), F.sum("n_bytes").alias("n_bytes"))
        one = one.select(F.lit(name).alias("log"), "*", F.lit(kinds.count("segment")).cast("long").alias("segments"), F.lit(kinds.count("chunk")).cast("long").alias("chunks"))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"WITH {_CHUNK}, t AS (" + " UNION ALL ".join(f"SELECT log, chunk // {4**k} AS node, min(first) AS first, max(last) AS last, count(*) AS chunk_count, {k} AS level FROM chunk GROUP BY log, chunk // {4**k}" for k in (1, 2, 3)) + """)
    SELECT log, level, node, first, last, chunk_count FROM t QUALIFY row_number() OVER (PARTITION BY log, level ORDER BY node DESC) = 1""")
def catalog_right_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.right_spine(catalog.levels(chunks(spark, sf_dir), 4, 3))


@query(f"""WITH {_COMMITS}, c AS (SELECT ref, generation, CASE WHEN event_id % 7 = 0 THEN 'stale' ELSE sha256(encode(target)) END AS digest FROM commits UNION ALL SELECT DISTINCT ref, CAST(99999999 AS BIGINT), 'none' FROM commits)
    SELECT c.ref, c.generation, coalesce(c.digest = sha256(encode(k.target)), false) AS valid FROM c LEFT JOIN commits k ON c.ref = k.ref AND c.generation = k.generation""")
def cached_result_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir).withColumn("digest", F.sha2(F.col("target").cast("binary"), 256))
    cache = rows.select("ref", "generation", F.when(F.col("event_id") % 7 == 0, "stale").otherwise(F.col("digest")).alias("digest"))
    beyond = rows.select("ref").distinct().select("ref", F.lit(99999999).cast("long").alias("generation"), F.lit("none").alias("digest"))
    return idempotency.cached(cache.unionByName(beyond), rows, "ref").select("ref", "generation", "valid")


@query(f"WITH {_KEYED} SELECT log, count(DISTINCT sk) AS n_entries FROM keyed GROUP BY log")
def index_entry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idempotency.entry_count(keyed(spark, sf_dir), "log", "sk")


_OUTCOME = "CASE WHEN event_id % 10 < 6 THEN 'acked' WHEN event_id % 10 = 6 THEN 'failed' WHEN event_id % 10 = 7 THEN 'ambiguous' ELSE 'fault' END"


@query(f"""WITH o AS (SELECT event_type, {_OUTCOME} AS outcome, event_id % 17 <> 3 AS kept FROM events)
    SELECT event_type, count(*) FILTER (WHERE outcome = 'acked') AS acked, count(*) FILTER (WHERE outcome = 'failed') AS clean_failures, count(*) FILTER (WHERE outcome = 'fault') AS faults,
    count(*) FILTER (WHERE outcome = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE outcome = 'acked' AND NOT kept) AS violations FROM o GROUP BY event_type""")
def chaos_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.chaos_report(events(spark, sf_dir).select("event_type", F.expr(_OUTCOME).alias("outcome"), (F.col("event_id") % 17 != 3).alias("kept")), "event_type")


# Identity and objects


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query(f"SELECT doc_id, {_hmac('encode(text)')} AS digest FROM documents")
def keyed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", identity.keyed_digest(KEY, F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT event_id, {_domain('stable-request', 'encode(event_type)', 'encode(CAST(user_id AS VARCHAR))', 'encode(props)')} AS request, {_domain('payload', 'encode(props)')} AS payload_hash FROM events")
def domain_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lambda c: F.col(c).cast("string").cast("binary")
    return events(spark, sf_dir).select("event_id", identity.request_hash(KEY, F.col("event_type"), b("user_id"), b("props")).alias("request"), identity.payload_hash(KEY, b("props")).alias("payload_hash"))


_BODY = " || ".join([_u64("2"), *(f"{_framed(f'encode({n})')} || {_framed(f'encode({v})')}" for n, v in (("'epoch'", "CAST(user_id AS VARCHAR)"), ("'target'", "event_type"))), _u64("2"), _framed("encode(props)"), _framed("encode(event_type)")])


@query("SELECT event_id, " + _domain("material", "encode('t')", "encode('append')", "encode(event_type)", f"({_BODY})") + " AS request FROM events")
def material_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    unsorted = F.array(pair("target", F.col("event_type")), pair("epoch", F.col("user_id")))
    payloads = F.array(F.col("props").cast("binary"), F.col("event_type").cast("binary"))
    return events(spark, sf_dir).select("event_id", identity.material_hash(KEY, F.lit("t"), F.lit("append"), F.col("event_type"), unsorted, payloads).alias("request"))


_DIGESTISH = "CASE doc_id % 4 WHEN 0 THEN 'hs2:' || {h} WHEN 1 THEN 'hs2:' || upper({h}) WHEN 2 THEN 'hs2:' || substr({h}, 2) ELSE 'b3k:' || {h} END"


@query(f"WITH d AS (SELECT doc_id, {_DIGESTISH.format(h='sha256(encode(text))')} AS d FROM documents) SELECT doc_id, regexp_full_match(d, 'hs2:[0-9a-f]{{64}}') AS valid FROM d")
def digest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).select("doc_id", F.expr(_DIGESTISH.format(h="h")).alias("d"))
    return d.select("doc_id", checks.valid_digest(F.col("d")).alias("valid"))


_NAMEISH = "CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type || '..x' WHEN 2 THEN '.' || event_type WHEN 3 THEN event_type || '/' || user_id WHEN 4 THEN repeat('a', 120 + CAST(event_id % 20 AS INT)) ELSE '9-' || event_type || '_' || user_id || '.v1' END"


@query(f"WITH n AS (SELECT event_id, {_NAMEISH} AS name FROM events) SELECT event_id, name, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]*') AND length(name) <= 128 AND NOT contains(name, '..') AS valid FROM n")
def name_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.expr(_NAMEISH).alias("name")).withColumn("valid", checks.valid_log_name(F.col("name")))


@query("SELECT doc_id, lower(hex(unhex(lpad(to_hex(octet_length(encode(source || doc_id))), 8, '0')) || encode(source || doc_id) || unhex('00000020') || unhex(sha256(encode(text))))) AS stable_key FROM documents")
def document_stable_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = identity.document_stable_key(F.concat("source", F.col("doc_id").cast("string")), F.sha2(F.col("text").cast("binary"), 256))
    return rows.select("doc_id", identity.hex_of(key).alias("stable_key"))


@query(f"SELECT {_hmac('encode(text)')} AS digest, min(doc_id) AS first_id, count(*) AS copies, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY text")
def blob_put_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.put(documents(spark, sf_dir), KEY, "text", "doc_id")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("text").cast("binary")
    broken = F.when(F.col("doc_id") % 10 == 1, F.concat(data, F.lit(bytearray(b"!")))).when(F.col("doc_id") % 10 == 2, F.concat(F.lit(bytearray(b"?")), F.substring(data, 2, 1 << 30))).otherwise(data)
    return documents(spark, sf_dir).select("doc_id", identity.keyed_digest(KEY, data).alias("digest"), F.octet_length(data).cast("long").alias("plaintext_bytes"), broken.alias("payload"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END > 20000 THEN 'too_large' WHEN doc_id % 10 = 1 THEN 'size_mismatch'
    WHEN doc_id % 10 = 2 AND octet_length(encode(substr(text, 1, 1))) = 1 AND substr(text, 1, 1) <> '?' THEN 'digest_mismatch' WHEN doc_id % 10 = 2 THEN 'digest_mismatch' ELSE 'ok' END AS verdict FROM documents""")
def object_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.verify(_objects(spark, sf_dir), KEY, 20000).select("doc_id", "verdict")


@query(f"SELECT {_hmac('encode(text)')} AS digest, text FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 7)")
def blob_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("digest", identity.keyed_digest(KEY, F.col("text").cast("binary")))
    return blobs.get(rows, rows.where("doc_id = 7").first().digest).select("digest", "text")


@query(f"""WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) <= 3000)
    SELECT 't1' AS tenant, 'document' AS kind, 'doc/1' AS schema, {_domain('object', "encode('document')", "encode('doc/1')", 'encode(text)')} AS digest, min(doc_id) AS first_id, count(*) AS copies, CAST(any_value(n) AS BIGINT) AS plaintext_bytes
    FROM d GROUP BY text""")
def object_put_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.put_object(documents(spark, sf_dir), KEY, "t1", "document", "doc/1", "text", "doc_id", 3000)


_ENVELOPE = "CASE doc_id % 7 WHEN 0 THEN 't2' ELSE 't1' END AS tenant, CASE doc_id % 5 WHEN 0 THEN 'image' ELSE 'document' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'doc/9' ELSE 'doc/1' END AS schema"


@query(f"""WITH e AS (SELECT doc_id, {_ENVELOPE}, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, CASE WHEN tenant <> 't1' THEN 'tenant_mismatch' WHEN kind <> 'document' THEN 'unknown_kind' WHEN schema <> 'doc/1' THEN 'unknown_schema' WHEN n > 3000 THEN 'too_large' ELSE 'ok' END AS verdict FROM e""")
def object_decodable(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelopes = documents(spark, sf_dir).selectExpr("doc_id", *_ENVELOPE.split(", "), "octet_length(text) AS plaintext_bytes")
    return blobs.decodable(envelopes, "t1", [("document", "doc/1")], 3000).select("doc_id", "verdict")


@query(f"""WITH d AS (SELECT doc_id, source, {_hmac('encode(text)')} AS d FROM documents)
    SELECT doc_id, 'objects/t1/' || substr(d, 5, 2) || '/' || substr(d, 5) AS object_key, 'refs/t1/' || source AS ref_key, 'ops/t1/' || substr(sha256(encode(d)), 1, 2) || '/' || d AS intent_key FROM d""")
def object_key_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("d", identity.keyed_digest(KEY, F.col("text").cast("binary")))
    t = F.lit("t1")
    return rows.select("doc_id", identity.object_key(t, F.col("d")).alias("object_key"), identity.ref_key(t, F.col("source")).alias("ref_key"), identity.intent_key(t, F.col("d")).alias("intent_key"))


# Graph


@query("SELECT DISTINCT event_id AS src, unnest(['hs2:' || sha256(encode(props)), 'hs2:' || sha256(encode(event_type))]) AS dst FROM events")
def digest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c: F.concat(F.lit("hs2:"), F.sha2(F.col(c).cast("string").cast("binary"), 256))
    # as a key, quoted inside a string, and beside other text a digest is no edge
    key, quoted = F.create_map(h("user_id"), F.lit("hs2:")), F.concat(F.lit('see "'), h("event_id"), F.lit('" and "'))
    body = F.to_json(F.struct(h("props").alias("head"), F.array(h("event_type")).alias("list"), F.concat(F.lit("see "), h("event_type")).alias("note"), key.alias("keys"), quoted.alias("quoted")))
    return reach.digest_edges(events(spark, sf_dir).select("event_id", body.alias("body")), "event_id", "body")


_EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
    UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
_GRAPH = f"""{_EDGES},
    reached AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 40 = 1 UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    lines = t("lineitem")
    out = e(t("customer"), "c", "c_custkey", "n", "c_nationkey").union(e(t("orders"), "c", "o_custkey", "o", "o_orderkey")).union(e(lines, "o", "l_orderkey", "p", "l_partkey"))
    return out.union(e(lines, "o", "l_orderkey", "s", "l_suppkey")).union(e(t("supplier"), "s", "s_suppkey", "n", "s_nationkey"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 40 = 1").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.reachable(_roots(spark, sf_dir), graph(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderdate").alias("modified"))


_SWEEP_NOW = "2001-01-01 00:00:00"


@query(f"WITH RECURSIVE {_GRAPH} SELECT node FROM reached")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir).select("node")


@query(f"WITH RECURSIVE {_GRAPH} SELECT 'o' || o_orderkey AS node, o_orderdate AS modified FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT node FROM reached) AND o_orderdate <= TIMESTAMP '{_SWEEP_NOW}' - INTERVAL 30 DAY")
def sweep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.candidates(_orders(spark, sf_dir), _reached(spark, sf_dir), F.lit(_SWEEP_NOW).cast("timestamp_ntz"), 30)


@query(f"""WITH RECURSIVE {_GRAPH}, c AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT node FROM reached) AND o_orderdate <= TIMESTAMP '{_SWEEP_NOW}' - INTERVAL 30 DAY)
    SELECT node, greatest((SELECT count(*) FROM c) - 20, 0) AS more FROM c ORDER BY node LIMIT 20""")
def sweep_first_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.first_names(reach.candidates(_orders(spark, sf_dir), _reached(spark, sf_dir), F.lit(_SWEEP_NOW).cast("timestamp_ntz"), 30))


@query(f"""WITH RECURSIVE {_GRAPH}, m AS (SELECT 'o' || o_orderkey NOT IN (SELECT node FROM reached) AS free, o_orderdate <= TIMESTAMP '{_SWEEP_NOW}' - INTERVAL 30 DAY AS old FROM orders)
    SELECT (SELECT count(*) FROM customer WHERE c_custkey % 40 = 1) AS refs_scanned, count(*) AS objects_scanned, (SELECT count(*) FROM reached) AS reachable, count(*) FILTER (WHERE free AND NOT old) AS in_grace, count(*) FILTER (WHERE free AND old) AS candidates, CAST(0 AS BIGINT) AS deleted FROM m""")
def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.report(_orders(spark, sf_dir), _reached(spark, sf_dir), _roots(spark, sf_dir).count(), F.lit(_SWEEP_NOW).cast("timestamp_ntz"), 30)


# Protocol


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import bridge

    return bridge.sample_lines(events(spark, sf_dir))


@query("""SELECT event_id, 'r' || event_id AS id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 'drop' WHEN 0 THEN 'append' ELSE 'read' END AS op,
    CASE event_id % 5 WHEN 4 THEN 'invalid_json' WHEN 3 THEN 'invalid_request' WHEN 1 THEN 'unsupported' WHEN 2 THEN CASE WHEN event_id % 300 BETWEEN 1 AND 256 THEN 'ok' ELSE 'invalid_request' END ELSE 'ok' END AS status FROM events""")
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import bridge

    return bridge.parse(requests(spark, sf_dir)).select("event_id", "id", "op", "status")


@query("SELECT event_id, 'r' || event_id AS id FROM events")
def extract_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import bridge

    return requests(spark, sf_dir).select("event_id", bridge.extract_id(F.col("line")).alias("id"))


@query(f"""WITH {_LOG} SELECT log, CAST(seq AS VARCHAR) AS seq, strftime("at", '%Y-%m-%dT%H:%M:%S.%fZ') AS "at", lower(hex(encode(payload))) AS payload_hex FROM log""")
def wire_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import bridge

    return log(spark, sf_dir).select("log", *bridge.wire(F.col("seq"), F.col("at"), F.col("payload")))


# Beyond the reference's code (specified there only)


@query(f"""WITH {_LOG} SELECT log, max(seq) AS seq FROM log WHERE "at" <= TIMESTAMP '{NOW}' GROUP BY log""")
def seek_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.seek_time(log(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query("SELECT event_id, CAST(CAST('0x' || substr(sha256(encode(CAST(user_id AS VARCHAR))), 1, 8) AS BIGINT) % 16 AS INTEGER) AS part FROM events")
def partition_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", identity.partition_of(F.col("user_id"), 16).alias("part"))


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, (greatest(length(text), 1) - 1) // 1000)) AS piece FROM documents)
    SELECT doc_id, piece, sha256(encode(substr(text, piece * 1000 + 1, 1000))) AS digest FROM c""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.pieces(documents(spark, sf_dir), "text").select("doc_id", "piece", "digest")


@query(f"""WITH {_LOG}, w AS (SELECT event_type AS log, event_id + event_id % 2 AS event_id FROM events WHERE event_id % 7 = 0)
    SELECT w.log, w.event_id, l.seq FROM w LEFT JOIN log l ON w.log = l.log AND w.event_id = l.event_id""")
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = events(spark, sf_dir).where("event_id % 7 = 0").select(F.col("event_type").alias("log"), (F.col("event_id") + F.col("event_id") % 2).alias("event_id"))
    return holdings.by_id(log(spark, sf_dir), wanted, ["log", "event_id"])


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS ref, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 + CASE WHEN c_custkey % 11 = 0 THEN 100000000 ELSE 0 END END AS symbol, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS target FROM customer),
    walk AS (SELECT ref, symbol AS nxt, target, 0 AS hops, true AS there FROM r
        UNION ALL SELECT w.ref, r.symbol, r.target, w.hops + 1, r.ref IS NOT NULL FROM walk w LEFT JOIN r ON r.ref = w.nxt WHERE w.nxt IS NOT NULL AND w.there AND w.hops < 4)
    SELECT ref, CASE WHEN there AND nxt IS NULL THEN target END AS target, hops, CASE WHEN NOT there THEN 'dangling' WHEN nxt IS NOT NULL THEN 'too_deep' ELSE 'ok' END AS status
    FROM walk QUALIFY row_number() OVER (PARTITION BY ref ORDER BY hops DESC) = 1""")
def symbolic_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    symbol = F.when(k % 3 == 0, F.floor(k / 3) + F.when(k % 11 == 0, 100_000_000).otherwise(0))
    return holdings.resolve(spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("ref"), symbol.alias("symbol"), F.when(k % 3 != 0, F.col("c_name")).alias("target")))


@query(f"WITH {_COMMITS} SELECT ref, max(generation) AS generation, max_by(target, generation) AS target FROM commits WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ref")
def release_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings.release(commits(spark, sf_dir), "ref", F.lit(NOW).cast("timestamp_ntz"))


_PINS = "SELECT 's' || s_suppkey AS node, CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (s_suppkey % 40) END AS expires FROM supplier WHERE s_suppkey % 3 = 1"


@query(f"""WITH RECURSIVE {_EDGES}, pins AS ({_PINS}),
    roots AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 400 = 1 UNION SELECT node FROM pins WHERE expires IS NULL OR expires > TIMESTAMP '{NOW}'),
    reached AS (SELECT node FROM roots UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node) SELECT node FROM reached""")
def pinned_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    expires = F.when(key % 5 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((key % 40).cast("int")))
    pins = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 1").select(F.concat(F.lit("s"), key).alias("node"), expires.alias("expires"))
    roots = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 400 = 1").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return reach.reachable(holdings.live_roots(roots, pins, F.lit(NOW).cast("timestamp_ntz")), graph(spark, sf_dir)).select("node")


@query("""WITH o AS (SELECT source || '/' || doc_id AS path, sha256(encode(text)) AS digest FROM documents WHERE doc_id % 17 <> 0),
    n AS (SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE sha256(encode(text)) END AS digest FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.digest IS DISTINCT FROM n.digest""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    new = rows.where("doc_id % 11 <> 0").withColumn("digest", F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("digest")))
    return holdings.tree_diff(rows.where("doc_id % 17 <> 0"), new)


@query(f"WITH {_LOG}, h AS (SELECT log, max(seq) AS head_seq FROM log GROUP BY log) SELECT log, head_seq, head_seq - coalesce(c - 1, 0) AS lag FROM (SELECT log, head_seq, CASE log WHEN 'click' THEN 5 WHEN 'view' THEN head_seq + 1 WHEN 'error' THEN head_seq - 3 END AS c FROM h)")
def reader_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = feed.heads(log(spark, sf_dir)).select("log", "head_seq")
    cursor = F.expr("CASE log WHEN 'click' THEN 5 WHEN 'view' THEN head_seq + 1 WHEN 'error' THEN head_seq - 3 END")
    return holdings.lag(heads, heads.select("log", cursor.alias("cursor")).where("cursor IS NOT NULL"), "log").select("log", "head_seq", "lag")


@query("""WITH e AS (SELECT text, octet_length(encode(text)) AS n, max(doc_id % 3 = 0) AS kept, count(*) AS c FROM documents GROUP BY text)
    SELECT CAST(sum(n * c) AS BIGINT) AS logical_bytes, CAST(sum(n) AS BIGINT) AS unique_bytes, CAST(sum(n) FILTER (WHERE kept) AS BIGINT) AS retained_bytes, count(*) AS objects FROM e""")
def storage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", identity.keyed_digest(KEY, F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    return holdings.accounting(rows, F.col("doc_id") % 3 == 0)


@query("""WITH refs AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 2 = 0), objects AS (SELECT 'o' || o_orderkey AS node, o_orderkey % 31 <> 0 AS ok FROM orders WHERE o_orderkey % 29 <> 0),
    f AS (SELECT coalesce(o.node, r.node) AS node, CASE WHEN o.node IS NULL THEN 'missing' WHEN NOT o.ok THEN 'corrupt' WHEN r.node IS NULL THEN 'orphan' END AS finding FROM objects o FULL JOIN refs r ON o.node = r.node)
    SELECT node, finding FROM f WHERE finding IS NOT NULL""")
def fsck(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.concat(F.lit("o"), "o_orderkey").alias("node"))
    edges = orders.where("o_custkey % 3 <> 0 AND o_orderkey % 2 = 0").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("node").alias("dst"))
    reached = reach.reachable(edges.select(F.col("src").alias("node")), edges).where("node LIKE 'o%'")
    return holdings.fsck(edges, orders.where("o_orderkey % 29 <> 0").select("node", (F.col("o_orderkey") % 31 != 0).alias("ok")), reached)


_WRITES = "w AS (SELECT user_id % 4 AS volume, event_id % 64 AS block, event_id AS seq, props AS data FROM events)"


@query(f"WITH {_WRITES}, m AS (SELECT max(seq) // 2 AS k FROM w) SELECT volume, block, max_by(data, seq) AS data, max(seq) AS seq FROM w, m WHERE seq <= k GROUP BY volume, block")
def volume_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = events(spark, sf_dir).select((F.col("user_id") % 4).alias("volume"), (F.col("event_id") % 64).alias("block"), F.col("event_id").alias("seq"), F.col("props").alias("data"))
    return holdings.blocks_at(writes, F.lit(writes.agg(F.max("seq")).first()[0] // 2))


@query(f"""WITH {_COMMITS}, n AS (SELECT *, max(generation) OVER (PARTITION BY ref) AS newest FROM commits)
    SELECT ref, generation, CASE WHEN generation % 50 = 0 THEN 'hold' WHEN generation > newest - 5 THEN 'last' WHEN ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'recent' ELSE 'expired' END AS rule FROM n""")
def retention_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings.retained(commits(spark, sf_dir), "ref", F.lit(NOW).cast("timestamp_ntz"), 7, 5, F.col("generation") % 50 == 0).select("ref", "generation", "rule")


@query(f"WITH RECURSIVE {_LEASE} SELECT o.writer AS actor, 'ref.' || o.op AS action, o.at_us, w.ref, w.event_id, w.generation FROM walk w JOIN o ON o.ref = w.ref AND o.k = w.k WHERE w.k > 0 AND w.status = 'ok'")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdings.audit(folds.lease_machine(lease_ops(spark, sf_dir), _TTL), "writer", "op", "at_us")


# Streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = events(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives over all there is now, as a table in the shared folder."""
    at = own_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"WITH {_SUBMITTED} SELECT log, seq, payload FROM framed WHERE seq > 3")
def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of all events, in three commits each, followed as streams from number 4."""
    from .streaming import follow

    feeds, rows, at = _feeds(spark, "followed"), _submitted(spark, sf_dir), own_path(spark, "follow")
    size = rows.agg(F.max("event_id")).first()[0] // 3 + 1
    for name in ("even", "odd"):
        for k in range(3):
            feeds.append(name, f"op{k}", "w", rows.where((F.col("log") == name) & (F.floor(F.col("event_id") / size) == k)), f"r{k}", 3600, limit=0)

        def sink(frames: DataFrame, number: int, name: str = name) -> None:
            frames.select(F.lit(name).alias("log"), "seq", F.col("payload").cast("string").alias("payload")).write.mode("overwrite").parquet(f"{at}/out/{name}/{number}")

        follow.follow_commits(spark, feeds.root, name, sink, f"{at}/checkpoint/{name}", 4).awaitTermination()
    return spark.read.schema("log string, seq long, payload string").option("recursiveFileLookup", "true").parquet(f"{at}/out")


@query(SQL["group_commit_batches"])
def stream_group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import follow

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _stream(spark, sf_dir).select(F.col("event_type").alias("log"), at.alias("at_us"), "event_id", (1 + F.col("event_id") % 2).alias("n"))
    return _streamed(spark, follow.group_commit(rows, "log", 3 * 3600 * 1_000_000, 8), "group")
