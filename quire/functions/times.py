"""Time functions: ISO text, zones, week buckets, v1 UUID time (SC3-SC7, SC15, SC17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone events are created in, and the ISO formats used.
EVENT_TZ = "Europe/Berlin"
ISO_NTZ = "yyyy-MM-dd'T'HH:mm:ss"
RFC3339_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Offset between the UUID epoch (1582-10-15) and the Unix epoch, in 100 ns ticks.
UUID_EPOCH_OFFSET = 122192928000000000
_OFFSET_RE = r"(Z|[+-]\d\d:?\d\d)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz_lit(v) -> Column:
    """A zone-free literal: datetime -> timestamp_ntz, date -> date (independent of session and host zones)."""
    import datetime as _dt
    if isinstance(v, Column):
        return v.cast("timestamp_ntz")
    if isinstance(v, _dt.datetime):
        return F.lit(v.replace(tzinfo=None).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    if isinstance(v, _dt.date):
        return F.lit(v.isoformat()).cast("date")
    return F.lit(str(v)).cast("timestamp_ntz")


def week_start(ts) -> Column:
    """SC17: Monday of the week (7-day partition key). Never mixed with ``window()``."""
    return F.to_date(F.date_trunc("week", _c(ts)))


def iso(ts) -> Column:
    """SC5: ISO text without zone."""
    return F.date_format(_c(ts), ISO_NTZ)


def plus_hours(ts, hours: int = 1) -> Column:
    """SC6."""
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))


def to_utc(ts, tz: str = EVENT_TZ) -> Column:
    """SC7: wall time in ``tz`` -> UTC wall time (DST aware); result stays timestamp_ntz."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts).cast("timestamp_ntz"))


def rfc3339_utc(ts, tz: str = EVENT_TZ) -> Column:
    """SK4 due text, e.g. 2024-11-05T12:00:00Z."""
    return F.date_format(to_utc(ts, tz), RFC3339_UTC)


def parse_iso(text, tz: str = EVENT_TZ) -> Column:
    """SC4 / D22: ISO text -> timestamp_ntz wall time in ``tz``.

    Text with an offset (``Z`` / ``+02:00``) names an instant: it is moved to UTC
    by the offset and then to ``tz`` wall time (DST aware). Text without one is
    taken as wall time. Bad text -> null. Independent of the session time zone.
    """
    t = F.trim(_c(text))
    off = F.regexp_extract(t, _OFFSET_RE, 1)
    base = F.regexp_replace(t, _OFFSET_RE, "").try_cast("timestamp_ntz")
    digits = F.regexp_replace(off, "[^0-9]", "")
    minutes = F.when(off == "Z", F.lit(0)).otherwise(
        F.when(off.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))
    utc_wall = base - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    with_regex = F.when(off == "", base).otherwise(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall))
    # cheap routing: only text that may end in an offset ('Z', '+hh:mm', '+hhmm') pays for the regexes
    maybe_off = (t.endswith("Z") | (F.substring(t, -6, 1).isin("+", "-") & (F.substring(t, -3, 1) == ":"))
                 | F.substring(t, -5, 1).isin("+", "-"))
    return F.when(maybe_off, with_regex).otherwise(t.try_cast("timestamp_ntz"))


_DAY_US = 86_400_000_000


def ntz_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp_ntz wall time (no zone involved)."""
    t = _c(ts).cast("timestamp_ntz")
    sec = F.extract(F.lit("SECOND"), t)  # seconds with the fraction, decimal(8,6)
    return (F.unix_date(F.to_date(t)).cast("bigint") * F.lit(_DAY_US)
            + (F.hour(t) * 3600 + F.minute(t) * 60).cast("bigint") * F.lit(1_000_000)
            + (sec * F.lit(1_000_000)).cast("bigint"))


def micros_ntz(micros) -> Column:
    """Inverse of ``ntz_micros``."""
    m = _c(micros).cast("bigint")
    days = F.floor(m / F.lit(_DAY_US)).cast("int")
    rest = (m - days.cast("bigint") * F.lit(_DAY_US)).cast("decimal(18,6)") / F.lit(1_000_000)
    return (F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rest))


def uuid_v1(ts, node, clock_seq=None) -> Column:
    """SC3 (build): a version-1 UUID carrying ``ts`` (timestamp_ntz, UTC) and a 48-bit ``node``.

    The 60-bit count of 100 ns ticks since 1582-10-15 is split into time_low,
    time_mid and time_hi; the version nibble is 1 and the variant bits are 10.
    """
    ticks = ntz_micros(ts) * F.lit(10) + F.lit(UUID_EPOCH_OFFSET)
    h = F.lpad(F.lower(F.hex(ticks)), 15, "0")
    seq = F.lit(0) if clock_seq is None else _c(clock_seq)
    clock = F.lpad(F.lower(F.hex(F.lit(0x8000) + F.pmod(seq.cast("bigint"), F.lit(0x4000)))), 4, "0")
    node_hex = F.lpad(F.lower(F.hex(F.pmod(_c(node).cast("bigint"), F.lit(1 << 48)))), 12, "0")
    return F.concat(F.substring(h, 8, 8), F.lit("-"), F.substring(h, 4, 4), F.lit("-1"), F.substring(h, 1, 3),
                    F.lit("-"), clock, F.lit("-"), node_hex)


def uuid_v1_time(uuid_text) -> Column:
    """SC3: creation time carried by a version-1 UUID, as timestamp_ntz (UTC)."""
    u = _c(uuid_text)
    hexts = F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8))
    ticks = F.conv(hexts, 16, 10).cast("decimal(38,0)")
    micros = ((ticks - F.lit(UUID_EPOCH_OFFSET)) / F.lit(10)).cast("bigint")
    return micros_ntz(micros)
