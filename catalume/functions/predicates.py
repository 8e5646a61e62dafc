"""Tests of catalogue rows, as functions from columns to boolean columns. Times are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalume.functions.scalars import present, under_host, url_part


def has_image(*assets: Column) -> Column:
    """Any of the asset columns is set."""
    return F.coalesce(*assets).isNotNull()


def valid_imdb(value: Column) -> Column:
    return F.coalesce(value.rlike("^tt[0-9]{7,}$"), F.lit(False))


def valid_number(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike("^[1-9][0-9]*$"), F.lit(False))


def at_least(array: Column, n: int) -> Column:
    """An array of n elements or more; null and JSON text that is no array do not pass."""
    return F.coalesce(F.size(array) >= n, F.lit(False))


def json_at_least(text: Column, n: int) -> Column:
    return F.coalesce(F.json_array_length(text) >= n, F.lit(False))


def first_not_in(array: Column, values: list[str]) -> Column:
    """The first element is none of ``values``; an empty array passes."""
    return ~F.coalesce(F.try_element_at(array, F.lit(1)), F.lit("")).isin(*values)


def broken_url(url: Column, dead: list[str]) -> Column:
    """Blank, without a host, or on a dead host."""
    name = F.coalesce(F.lower(url_part(url, "HOST")), F.lit(""))
    return ~F.coalesce(present(url), F.lit(False)) | (name == "") | under_host(name, dead)


def good_source(streams: Column, thumb: Column, poster: Column, dead: list[str]) -> Column:
    """A stored source that needs no re-read: it has streams and no broken image."""
    return at_least(streams, 1) & ~broken_url(thumb, dead) & ~broken_url(poster, dead)


def summary_allowed(provider: Column, good: Column, streamless: Column) -> Column:
    """Whether a failed detail may be replaced by the summary of the list page: never over a source with streams; for the provider
    whose lists have no ids only where a summary stands already.
    """
    return ~good & F.when(provider == "nguonc", streamless).otherwise(True)


def since_midnight(ts: Column, now: Column) -> Column:
    """On the UTC day of ``now``, up to it (the session's zone must be UTC)."""
    return (ts >= F.date_trunc("day", now)) & (ts <= now)


def past_gate(gate: Column) -> Column:
    """Not reviewed yet, or passed."""
    return gate.isNull() | (gate == "passed")


def valid_email(text: Column, most: int = 254) -> Column:
    return F.coalesce((F.length(text) <= most) & text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def valid_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def valid_field(text: Column, least: int, most: int) -> Column:
    """A trimmed length within bounds."""
    return F.coalesce(F.length(F.trim(text)).between(least, most), F.lit(False))


def session_state(expires: Column, renewed: Column, now: Column, renew_after: str = "1 hour") -> Column:
    """expired, renew (valid, but renewed longer than ``renew_after`` ago) or valid."""
    late = renewed + F.expr(f"interval {renew_after}") <= now
    return F.when(expires.isNull() | (expires <= now), "expired").when(late, "renew").otherwise("valid")


def heartbeat_state(beat: Column, status: Column, updated: Column, now: Column, most_seconds: int, live: list[str]) -> Column:
    """ok, or why not: missing, invalid, stale, or the status."""
    age = F.unix_timestamp(now) - F.unix_timestamp(updated)
    ladder = F.when(beat.isNull(), "missing").when(updated.isNull(), "invalid").when(age > most_seconds, "stale")
    return ladder.when(~F.coalesce(status.isin(*live), F.lit(False)), F.coalesce(F.nullif(status, F.lit("")), F.lit("invalid-status"))).otherwise("ok")


def rate_limit_kind(message: Column, delay_ms: Column, daily_above_ms: int = 3_600_000) -> Column:
    """daily if the message says so or the wait is long, else short."""
    daily = F.coalesce(message.rlike("(?i)per-?day|daily"), F.lit(False)) | F.coalesce(delay_ms > daily_above_ms, F.lit(False))
    return F.when(daily, "daily").otherwise("short")


def transient_error(code: Column, message: Column, codes: list[str], pattern: str) -> Column:
    return F.coalesce(code.isin(*codes), F.lit(False)) | F.coalesce(message.rlike(pattern), F.lit(False))


def source_failure(status: Column) -> Column:
    """response_status and ttl_ms that a failed image source is remembered with: gone for an hour, busy for a minute, else half one."""
    gone, busy = status.isin(404, 410), status == 429
    code = F.when(gone, 404).when(busy, 503).otherwise(502)
    ttl = F.when(gone, 3_600_000).when(busy, 60_000).otherwise(30_000)
    return F.struct(code.alias("response_status"), ttl.cast("long").alias("ttl_ms"))
