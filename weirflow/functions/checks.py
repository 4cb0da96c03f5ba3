"""Validators and predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_APPEND_BYTES, MAX_APPEND_EVENTS, MAX_KEY_HEX, MAX_LOG_NAME, MAX_REQUEST_ID, OP_FIRST_USE_S, OP_SKEW_S, OP_WINDOW_S
from .identity import TAG, decimal_u64


def valid_digest(text: Column, tag: str = TAG) -> Column:
    """Exact tag, 64 lower-case digits."""
    return F.coalesce(text.rlike(f"^{tag}:[0-9a-f]{{64}}$"), F.lit(False))


def valid_log_name(name: Column) -> Column:
    """Letters, digits, dot, underscore and dash, beginning with a letter or digit, no two dots."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & (F.length(name) <= MAX_LOG_NAME) & ~name.contains(".."), F.lit(False))


def valid_request_id(text: Column) -> Column:
    return F.coalesce((F.length(text) >= 1) & (F.octet_length(text) <= MAX_REQUEST_ID), F.lit(False))


def valid_key_hex(text: Column) -> Column:
    return F.coalesce(text.rlike("^(?:[0-9a-f]{2})+$") & (F.length(text) <= MAX_KEY_HEX), F.lit(False))


def valid_cursor(text: Column) -> Column:
    """A decimal of at least one."""
    return F.coalesce(decimal_u64(text) >= 1, F.lit(False))


def lease_live(until: Column, now: Column) -> Column:
    """Strictly later than now; no lease is not live."""
    return F.coalesce(until > now, F.lit(False))


def time_gate(issued: Column, now: Column, had_intent: Column) -> Column:
    """P5: whether an operation id may still be used; the order of the tests matters."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(issued.cast("timestamp"))
    second = 1_000_000
    return (
        F.when(age < -OP_SKEW_S * second, "invalid").when(age >= OP_WINDOW_S * second, "unknown").when(~had_intent & (age > OP_FIRST_USE_S * second), "unknown").otherwise("ok")
    )


def admission(n_events: Column, n_bytes: Column, max_events: int = MAX_APPEND_EVENTS, max_bytes: int = MAX_APPEND_BYTES) -> Column:
    """An append's list of payloads."""
    return F.when(n_events == 0, "empty").when(n_events > max_events, "too_many").when(n_bytes > max_bytes, "too_large").otherwise("ok")


def page_limits(max_events: int, max_bytes: int, events_cap: int, bytes_cap: int) -> None:
    """Zero or beyond the cap is an error, never clamped."""
    from ..model import InvalidRequest

    if not 1 <= max_events <= events_cap or not 1 <= max_bytes <= bytes_cap:
        raise InvalidRequest(f"limits must be 1 to {events_cap} events and 1 to {bytes_cap} bytes")
