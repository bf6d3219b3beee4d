"""Keys from values: HMAC and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(value: Column, key: bytes) -> Column:
    """The HMAC of a text in hexadecimal: two SHA-256 of padded keys. ``key`` is a constant."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256))), 256)


def masked_id(value: Column, key: bytes) -> Column:
    return F.left(hmac_sha256(value, key), F.lit(16))


def cache_key(prefix: str, fields: dict[str, Column]) -> Column:
    """A key that does not depend on the order of the fields."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256))


def clamped(value: Column, fallback: int, low: int, high: int) -> Column:
    """A whole number between the bounds; ``fallback`` where the value is none."""
    number = value.try_cast("int")
    return F.when(number.isNull(), fallback).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))
