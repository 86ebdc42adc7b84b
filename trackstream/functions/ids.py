"""Deterministic identifiers, so that replays meet the rows they replay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def geofence_event_id(driver: Column, fence: Column, transition: Column, event_ms: Column) -> Column:
    """First 12 bytes, as 24 hex digits, of SHA-256 over driver|fence|transition|ms."""
    return F.substring(digest_id(driver, fence, transition, event_ms), 1, 24)


def digest_id(*parts: Column) -> Column:
    """SHA-256 over the parts, joined by ``|``."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def alert_id(kind: Column, subject: Column, event_ms: Column) -> Column:
    return F.concat_ws(":", kind, subject, event_ms)
