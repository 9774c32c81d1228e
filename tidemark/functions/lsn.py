"""Log sequence numbers as BIGINT columns, and the log's own clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Microseconds from 1970-01-01 to 2000-01-01 UTC, and the weight of the high word.
PG_EPOCH_MICROS = 946_684_800_000_000
HIGH_WORD = 4_294_967_296


def _hex_to_long(text: Column) -> Column:
    # conv() gives the unsigned value as text; values of 2^63 and more do not fit and become null
    return F.conv(text, 16, 10).try_cast("bigint")


def lsn_parse(text: Column) -> Column:
    """``HI/LO`` hexadecimal text to a position; null for malformed text or values >= 2^63."""
    hi = _hex_to_long(F.substring_index(text, "/", 1))
    lo = _hex_to_long(F.substring_index(text, "/", -1))
    valid = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$") & (hi < HIGH_WORD // 2)
    return F.when(valid, hi * F.lit(HIGH_WORD) + lo)


def lsn_format(pos: Column) -> Column:
    """Position to text: upper-case hexadecimal, high word unpadded, low word eight wide."""
    low = pos.bitwiseAND(F.lit(HIGH_WORD - 1))
    return F.concat(F.hex(F.shiftright(pos, 32)), F.lit("/"), F.lpad(F.hex(low), 8, "0"))


def lsn_from_bytes(raw: Column) -> Column:
    """Eight big-endian bytes to a position."""
    return F.when(F.octet_length(raw) == 8, _hex_to_long(F.hex(raw)))


def lsn_to_bytes(pos: Column) -> Column:
    return F.unhex(F.lpad(F.hex(pos), 16, "0"))


def lsn_diff(a: Column, b: Column) -> Column:
    """Bytes of log between two positions, ``a - b``."""
    return a - b


def lsn_ge(a: Column, b: Column) -> Column:
    return a >= b


def pg_micros_to_ts(micros: Column) -> Column:
    """Microseconds since 2000-01-01 UTC to a timestamp."""
    return F.timestamp_micros(micros + F.lit(PG_EPOCH_MICROS))


def ts_to_pg_micros(ts: Column) -> Column:
    """Inverse of :func:`pg_micros_to_ts`; times before 2000 saturate at 0."""
    return F.greatest(F.unix_micros(ts.cast("timestamp")) - F.lit(PG_EPOCH_MICROS), F.lit(0).cast("bigint"))
