"""Limits, error classes and schemas shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits that are part of observable behaviour.
MAX_APPEND_EVENTS = 2048
MAX_APPEND_BYTES = 512 * 1024
MAX_KEY_BYTES = 512
MAX_PAGE_EVENTS = 1024
MAX_PAGE_BYTES = 512 * 1024
MAX_WAIT_S = 30
MAX_LOG_NAME = 128
MAX_REQUEST_ID = 128
MAX_KEY_HEX = 1024
CATALOG_FANOUT = 32
PUBLISH_TRIES = 128
READ_TRIES = 8
OP_WINDOW_S = 7 * 24 * 3600
OP_FIRST_USE_S = 5 * 60
OP_SKEW_S = 2 * 60
GROUP_WINDOW_MS = 10
GROUP_EVENTS = 1024
GROUP_QUEUE = 4096
MAX_TTL_S = 600

FRAME = T.StructType([
    T.StructField("log", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("at", T.TimestampType(), False),
    T.StructField("payload", T.BinaryType(), False), T.StructField("n_bytes", T.LongType(), False), T.StructField("generation", T.LongType(), False),
])


class FeedError(Exception):
    """Root of all errors; ``code`` is the name on the wire."""

    code = "internal"


class NotFound(FeedError):
    code = "not_found"


class AlreadyExists(FeedError):
    code = "already_exists"


class Conflict(FeedError):
    """A conditional write lost."""

    code = "conflict"


class Fenced(FeedError):
    code = "fenced"

    def __init__(self, caller: int, live: int):
        super().__init__(f"epoch {caller} is fenced by {live}")
        self.caller, self.live = caller, live


class LeaseHeld(FeedError):
    code = "lease_held"

    def __init__(self, holder: str, until: float):
        super().__init__(f"held by {holder} until {until}")
        self.holder, self.until = holder, until


class LeaseExpired(FeedError):
    code = "lease_expired"


class Unavailable(FeedError):
    """The only class that a caller may retry as is."""

    code = "unavailable"


class Integrity(FeedError):
    code = "integrity"


class Trimmed(FeedError):
    code = "trimmed"

    def __init__(self, resume_at: int):
        super().__init__(f"resume at {resume_at}")
        self.resume_at = resume_at


class EventTooLarge(FeedError):
    code = "event_too_large"

    def __init__(self, seq: int, event_bytes: int, max_bytes: int):
        super().__init__(f"event {seq} has {event_bytes} bytes, the limit is {max_bytes}")
        self.seq, self.event_bytes, self.max_bytes = seq, event_bytes, max_bytes


class ObjectTooLarge(FeedError):
    code = "object_too_large"


class UnknownOperation(FeedError):
    code = "unknown_operation"


class IdempotencyConflict(FeedError):
    code = "idempotency_conflict"


class Busy(FeedError):
    """A bounded queue is full; nothing was taken."""

    code = "busy"


class DeadlineExceeded(FeedError):
    code = "deadline_exceeded"


class Cancelled(FeedError):
    code = "cancelled"


class StableKeyConflict(FeedError):
    code = "stable_key_conflict"


class InvalidRequest(FeedError):
    code = "invalid_request"


class Rejected(FeedError):
    code = "rejected"
