"""Scalar column functions: ids, masking, JSON, time texts, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Crockford's base-32 digits.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _digits(number: Column, count: int) -> list[Column]:
    """The low ``5 * count`` bits of ``number`` as base-32 digits, highest first."""
    return [
        F.substring(
            F.lit(CROCKFORD), F.shiftrightunsigned(number, 5 * at).bitwiseAND(31).cast("int") + 1, F.lit(1)
        )
        for at in reversed(range(count))
    ]


def sortable_id(ts_ms: Column) -> Column:
    """26 characters: ten for the millisecond, sixteen random. Sorts by time; random within one ms."""
    halves = F.array(F.xxhash64(F.expr("uuid()")), F.xxhash64(F.expr("uuid()")))
    # Inside the lambda each half is one value, whose digits are taken from the same number.
    suffix = F.array_join(F.transform(halves, lambda half: F.concat(*_digits(half, 8))), "")
    return F.concat(*_digits(ts_ms.cast("long"), 10), suffix)


def is_blank(text: Column) -> Column:
    """Null, or nothing but spaces and control characters."""
    return text.isNull() | text.rlike(r"^[\x00-\x20]*$")


def mask_card(card: Column) -> Column:
    """Only the last four characters stay readable."""
    text = card.cast("string")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(text) - 4, F.lit(0))), F.right(text, F.lit(4)))


def json_to_map(text: Column) -> Column:
    """Flat JSON object to string map; empty for null, blank or unreadable text."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def iso_instant(ts_ms: Column) -> Column:
    """ISO-8601 text in UTC; three decimals only where the millisecond is not zero."""
    seconds = F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.pmod(ts_ms, F.lit(1000))
    fraction = F.when(millis != 0, F.concat(F.lit("."), F.lpad(millis.cast("string"), 3, "0"))).otherwise("")
    return F.concat(seconds, fraction, F.lit("Z"))


def hour_start_ms(ts_ms: Column) -> Column:
    return (ts_ms - F.pmod(ts_ms, F.lit(3_600_000))).cast("long")


def utc_date(ts_ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts_ms / F.lit(86_400_000)).cast("int"))


def day_of_week(ts_ms: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(utc_date(ts_ms))


def year_month(ts_ms: Column) -> Column:
    date = utc_date(ts_ms)
    return F.year(date) * 100 + F.month(date)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def same_text(left: Column, right: Column) -> Column:
    return F.upper(left) == F.upper(right)


def correlation_id(header: Column, topic: Column, offset: Column) -> Column:
    return F.coalesce(header, F.concat(F.lit("unknown-"), topic, F.lit("-"), offset.cast("string")))


def fixed4(value: Column) -> Column:
    """Four decimals of a non-negative double, rounded on its exact binary value, ties upwards.

    The value is split in two halves whose products with 10 000 are exact, so that the
    comparison with one half is exact too.
    """
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    scaled, rest = high * F.lit(10000.0), (value - high) * F.lit(10000.0)
    whole = F.floor(scaled).cast("long")
    up = (scaled - whole.cast("double") - F.lit(0.5)) + rest >= 0
    units = whole + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(units / F.lit(10000)).cast("string"), F.lit("."), F.lpad(F.pmod(units, F.lit(10000)).cast("string"), 4, "0")
    )
