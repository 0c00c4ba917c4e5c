"""Outcomes: a value or a failure in one struct, and what decides between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a failure's kind and message keep.
KIND_BYTES, MESSAGE_BYTES = 128, 1024


def outcome(value: Column, failed: Column, kind: Column) -> Column:
    """struct<ok, value, failure>: value where not failed, else the failure's kind."""
    bad = F.coalesce(failed, F.lit(True))
    return F.struct((~bad).alias("ok"), F.when(~bad, value).alias("value"), F.when(bad, kind).alias("failure"))


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within limit bytes of UTF-8."""
    # each character's bytes from its code point's range; a prefix sum would need a loop, so try the few possible lengths
    raw = F.encode(text, "UTF-8")
    byte = lambda k: F.hex(F.substring(raw, k, 1))
    inside = lambda k: byte(k).between("80", "BF")  # noqa: E731  the k-th byte continues a character
    end = F.when(~inside(limit + 1), limit).when(~inside(limit), limit - 1).when(~inside(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def millis_up(amount: Column, unit_ms: int) -> Column:
    """A duration in units as whole milliseconds, rounded up."""
    return F.ceil(amount * unit_ms).cast("bigint")


def call_options(delay_s: Column, eta_ms: Column, expires_s: Column, now_ms: int) -> Column:
    """struct<delay_ms, expires_in_ms, refused>: a delay or an eta, not both, none negative, and no expiry before the start."""
    delay = F.coalesce(millis_up(delay_s, 1000), F.greatest(eta_ms - now_ms, F.lit(0)).cast("bigint"))
    delay = F.when(delay_s.isNotNull() | eta_ms.isNotNull(), delay)
    expires = millis_up(expires_s, 1000)
    refused = (
        F.when(delay_s.isNotNull() & eta_ms.isNotNull(), "delay_and_eta")
        .when((delay_s < 0) | (expires_s < 0), "negative")
        .when((delay > 0) & (expires <= delay), "expires_first")
    )
    good = lambda c: F.when(refused.isNull(), c)
    return F.struct(good(delay).alias("delay_ms"), good(expires).alias("expires_in_ms"), refused.alias("refused"))


def length_prefixed_hash(*fields: Column) -> Column:
    """A 60-bit number from SHA-256 over fields, each behind its length, so that no two lists of fields meet."""
    parts = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 15), 16, 10).cast("bigint")


def child_id(tag: str, parent: Column, index: Column) -> Column:
    """A child's id from its parent's and its index: the same however often it is made."""
    parts = [F.lit(tag), parent.cast("string"), index.cast("string")]
    return F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)
