"""Column expressions: parsing, labels, protocol flags, logarithms, clocks and hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "attack" in a label column, and texts that mean "no class".
POSITIVE_LABELS = ["1", "true", "attack", "malicious", "yes"]
EMPTY_CLASSES = ["", "nan", "None", "-"]
# Destination ports counted as services.
SERVICE_PORTS = [
    20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 123, 137, 138, 139, 143, 161, 389, 443, 445, 465, 514, 587, 631,
    993, 995, 1433, 1521, 3306, 3389, 5432, 5900, 8080, 8443,
]
# IP protocol numbers with an indicator column.
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}

BENIGN = "Benign"
DAY_MS = 86_400_000.0


def number(col: Column) -> Column:
    """Text or number to DOUBLE; anything malformed becomes NULL."""
    return col.try_cast("double")


def is_infinite(col: Column) -> Column:
    return (col == F.lit(float("inf"))) | (col == F.lit(float("-inf")))


def safe_numeric(col: Column) -> Column:
    """Number with NULL, NaN and both infinities replaced by 0."""
    x = number(col)
    return F.when(x.isNull() | F.isnan(x) | is_infinite(x), F.lit(0.0)).otherwise(x)


def port_number(col: Column) -> Column:
    return F.coalesce(number(col).try_cast("int"), F.lit(0))


def label_from_text(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col)).isin(POSITIVE_LABELS), F.lit(False)).cast("int")


def label_from_number(col: Column) -> Column:
    return (F.coalesce(number(col), F.lit(0.0)) > 0).cast("int")


def attack_class(col: Column | None, label: Column) -> Column:
    """Class name; Benign wherever the label is 0 or the text stands for "none"."""
    if col is None:
        return F.when(label == 1, F.lit("Attack")).otherwise(F.lit(BENIGN))
    text = F.trim(col)
    return F.when((label != 1) | text.isNull() | text.isin(EMPTY_CLASSES), F.lit(BENIGN)).otherwise(text)


def protocol_flag(col: Column, value: int) -> Column:
    return (F.coalesce(number(col), F.lit(0.0)).cast("bigint") == value).cast("double")


def log1p_clip(col: Column) -> Column:
    """log(1 + x) with negative x read as 0."""
    return F.log1p(F.greatest(col, F.lit(0.0)))


def is_service_port(col: Column) -> Column:
    return col.isin(SERVICE_PORTS)


def total_bytes(inbound: Column | None, outbound: Column | None) -> Column:
    parts = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (inbound, outbound) if c is not None]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def day_angle(start_ms: Column) -> Column:
    """Angle of the UTC time of day, a full turn per day."""
    return (F.lit(2.0 * math.pi) * F.pmod(start_ms / 1000.0, F.lit(86400.0))) / 86400.0


def minute_of_day(start_ms: Column) -> Column:
    return F.pmod(F.floor(start_ms / 60000.0), F.lit(1440))


def clip_extreme(col: Column, bound: float = 1e30) -> Column:
    """NaN and NULL to 0, everything else into [-bound, bound]."""
    clean = F.when(col.isNull() | F.isnan(col), F.lit(0.0)).otherwise(col)
    return F.greatest(F.least(clean, F.lit(bound)), F.lit(-bound))


def to_timestamp(start_ms: Column) -> Column:
    """Instant of an epoch-millisecond value; shown in the session time zone."""
    return F.timestamp_micros(F.floor(start_ms * 1000.0).cast("bigint"))


def to_day(start_ms: Column) -> Column:
    """UTC calendar day as text, whatever the session time zone."""
    days = F.floor(start_ms / DAY_MS).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def epoch_ms_of_ntz(name: str) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ column read as UTC, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)") / 1000.0


def hash_order(seed: int, key: Column) -> Column:
    """The random order of this library: md5 of ``seed:key``. Reproducible in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_int(hex_text: Column, start: int = 1, digits: int = 8) -> Column:
    """Some hex digits of a digest as an integer."""
    return F.conv(F.substring(hex_text, start, digits), 16, 10).cast("bigint")


def r6(col: Column) -> Column:
    """Round to six decimals without a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def rounded(col: Column, digits: int) -> Column:
    """``F.round`` of a double. Decimal arithmetic is left to numbers next to a tie, and to very large ones; others are told by their neighbour."""
    scaled = col * float(10**digits)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(float(10**digits))).otherwise(F.round(col, digits))


def first_argmax(scores: Column) -> Column:
    """0-based position of the largest score; the first one wins."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def entropy_bits(count: Column, total: Column) -> Column:
    """One term of a Shannon entropy in bits."""
    p = count / total
    return -p * F.log2(p)
