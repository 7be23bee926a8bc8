"""Logical types as column expressions: dates, times, timestamps, decimals, UUIDs and durations. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def date_to_days(c: Column | str) -> Column:
    """Days since 1970-01-01; of a date, a timestamp (rounded down) or text (a date or RFC 3339)."""
    return F.unix_date(F.to_date(_c(c)))


def days_to_date(c: Column | str) -> Column:
    return F.date_from_unix_date(_c(c))


def text_to_timestamp(c: Column | str) -> Column:
    """RFC 3339 or a date alone; null for other text."""
    return F.coalesce(F.try_to_timestamp(_c(c)), F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd")))


def timestamp_to_micros(c: Column | str) -> Column:
    return F.unix_micros(_c(c).cast("timestamp"))


def timestamp_to_millis(c: Column | str) -> Column:
    """Rounded down, also before 1970."""
    return F.unix_millis(_c(c).cast("timestamp"))


def timestamp_to_nanos(c: Column | str) -> Column:
    """An error beyond 64 bits."""
    return F.unix_micros(_c(c).cast("timestamp")) * F.lit(1000).cast("long")


def millis_to_timestamp(c: Column | str) -> Column:
    return F.timestamp_millis(_c(c))


def micros_to_timestamp(c: Column | str) -> Column:
    return F.timestamp_micros(_c(c))


def nanos_to_timestamp(c: Column | str) -> Column:
    """Rounded down to microseconds."""
    return F.timestamp_micros(F.floor(_c(c) / F.lit(1000).cast("decimal(20,0)")).cast("long"))


def interval_to_micros(c: Column | str) -> Column:
    """Microseconds of a day-time interval."""
    c = _c(c)
    day = F.extract(F.lit("DAY"), c).cast("long") * 86400_000_000
    seconds = F.extract(F.lit("SECOND"), c).cast("decimal(18,6)") * 1_000_000
    return day + F.extract(F.lit("HOUR"), c).cast("long") * 3600_000_000 + F.extract(F.lit("MINUTE"), c).cast("long") * 60_000_000 + seconds.cast("long")


def interval_to_millis(c: Column | str) -> Column:
    """An int: an error beyond 32 bits."""
    return F.floor(interval_to_micros(c) / 1000).cast("int")


def micros_to_interval(c: Column | str) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (_c(c) / F.lit(1_000_000).cast("decimal(12,0)")).cast("decimal(18,6)"))


def micros_of_day(c: Column | str) -> Column:
    """Microseconds since midnight."""
    return F.pmod(timestamp_to_micros(c), F.lit(86400_000_000).cast("long"))


def unscaled(c: Column | str, scale: int) -> Column:
    """The number times ten to the scale, rounded down (-1.001 with 2 is -101); of a decimal of up to 18 digits."""
    return F.floor(_c(c).cast("decimal(38,10)") * F.lit(10**scale).cast("decimal(19,0)")).cast("long")


def decimal_to_bytes(c: Column | str, scale: int) -> Column:
    """The shortest big-endian two's complement of the unscaled number (zero: one byte)."""
    text = F.lpad(F.hex(unscaled(c, scale)), 16, "0")
    short = F.when(unscaled(c, scale) >= 0, F.regexp_replace(text, "^(00(?=[0-7]))+(?=..)", "")).otherwise(F.regexp_replace(text, "^(FF(?=[89A-F]))+(?=..)", ""))
    return F.unhex(short)


def decimal_to_fixed(c: Column | str, scale: int, size: int) -> Column:
    """The same with the sign carried on to size bytes; an error if it doesn't fit."""
    short = decimal_to_bytes(c, scale)
    fill = F.when(unscaled(c, scale) < 0, F.repeat(F.lit("FF"), size)).otherwise(F.repeat(F.lit("00"), size))
    wide = F.unhex(F.concat(F.substr(fill, F.lit(1), (F.lit(size) - F.octet_length(short)) * 2), F.hex(short)))
    return F.when(F.octet_length(short) <= size, wide).otherwise(F.raise_error(F.lit(f"a number that doesn't fit {size} bytes")).cast("binary"))


def decimal_from_bytes(c: Column | str, scale: int) -> Column:
    """A decimal(38, scale) of up to 8 bytes; none are 0."""
    c = _c(c)
    negative = F.hex(F.substring(c, 1, 1)).rlike("^[89A-F]")
    wide = F.concat(F.substr(F.when(negative, F.lit("F" * 16)).otherwise(F.lit("0" * 16)), F.lit(1), F.lit(16) - F.octet_length(c) * 2), F.hex(c))
    number = F.conv(wide, 16, -10).cast("long")
    ten = F.lit(10**scale).cast("decimal(19,0)")
    return F.when(F.octet_length(c) == 0, F.lit(0)).otherwise((number.cast("decimal(19,0)") / ten).cast(f"decimal(38,{scale})")).cast(f"decimal(38,{scale})")


def uuid_to_bytes(c: Column | str) -> Column:
    c = _c(c)
    good = F.lower(c).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(good, F.unhex(F.replace(c, F.lit("-")))).when(c.isNotNull(), F.raise_error(F.lit("not a uuid")).cast("binary"))


def bytes_to_uuid(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.hex(_c(c))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def duration_to_bytes(c: Column | str) -> Column:
    """Of a struct of months, days and millis, each from 0 to 2**32 - 1."""
    c = _c(c)
    part = lambda name: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c.getField(name), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))
    good = F.lit(True)
    for name in ("months", "days", "millis"):
        good = good & c.getField(name).between(0, 4294967295)
    return F.when(good, F.concat(part("months"), part("days"), part("millis"))).when(c.isNotNull(), F.raise_error(F.lit("a duration out of range")).cast("binary"))


def bytes_to_duration(c: Column | str) -> Column:
    c = _c(c)
    part = lambda at: F.conv(F.hex(F.concat(*(F.substring(c, at + i, 1) for i in (3, 2, 1, 0)))), 16, 10).cast("long")
    return F.when(F.octet_length(c) == 12, F.struct(part(1).alias("months"), part(5).alias("days"), part(9).alias("millis")))


def duration_to_iso(c: Column | str) -> Column:
    """ISO 8601 text, as P1Y3M15DT1H30M0.500S; P0D for nothing."""
    c = _c(c)
    months, days, millis = c.getField("months"), c.getField("days"), c.getField("millis")
    some = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    hours, minutes, rest = F.floor(millis / 3_600_000), F.floor(millis / 60_000) % 60, millis % 60_000
    second = F.when(rest % 1000 == 0, F.floor(rest / 1000).cast("string")).otherwise(F.concat(F.floor(rest / 1000).cast("string"), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0")))
    time = F.concat(some(hours, "H"), some(minutes, "M"), F.when(rest > 0, F.concat(second, F.lit("S"))).otherwise(F.lit("")))
    text = F.concat(F.lit("P"), some(F.floor(months / 12), "Y"), some(months % 12, "M"), some(days, "D"), F.when(millis > 0, F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(text == "P", F.lit("P0D")).otherwise(text)


def varint(c: Column | str) -> Column:
    """A long as a zigzag varint of 1 to 10 bytes."""
    c = _c(c).cast("long")
    z = F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))
    out = F.lit(None).cast("binary")
    for n in range(10, 0, -1):
        digits = [F.shiftrightunsigned(z, 7 * i).bitwiseAND(127) + (0 if i == n - 1 else 128) for i in range(n)]
        text = F.unhex(F.concat(*(F.lpad(F.hex(d), 2, "0") for d in digits)))
        out = text if n == 10 else F.when(F.shiftrightunsigned(z, 7 * n) == 0, text).otherwise(out)
    return out


def varint_length(c: Column | str) -> Column:
    c = _c(c).cast("long")
    z = F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(F.shiftrightunsigned(z, 7 * n) == 0, F.lit(n)).otherwise(out)
    return out
