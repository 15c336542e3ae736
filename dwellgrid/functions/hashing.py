"""Deterministic keys built from built-in hash functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.fixed_values import NAMESPACE_OID_HEX


def uuid5(name: Column) -> Column:
    """RFC 4122 name-based UUID (version 5, OID namespace) as lower-case text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID_HEX)), F.encode(name, "UTF-8")))
    variant_nibble = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant_nibble, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def session_key(visitor: Column, store: Column, day: Column, seq: Column) -> Column:
    """Session id of a visitor's visit number ``seq`` on one UTC day."""
    return uuid5(F.concat_ws(":", visitor, store, F.date_format(day, "yyyy-MM-dd"), seq.cast("string")))


def semantic_key(visitor: Column, event_type: Column, ts: Column) -> Column:
    """16 hex digits that label one visitor, event type and second; too short to be a key of their own."""
    second = F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.substring(F.sha2(F.concat_ws(":", visitor, event_type, second), 256), 1, 16)


def track_number(raw_id: Column) -> Column:
    """Trailing digits after the last underscore as text without leading zeros, else a stable hash below 100000."""
    tail = F.element_at(F.split(raw_id, "_"), -1)
    hashed = F.pmod(F.xxhash64(raw_id), F.lit(100000)).cast("string")
    return F.when(tail.rlike("^[0-9]+$"), F.regexp_replace(tail, "^0+(?=.)", "")).otherwise(hashed)
