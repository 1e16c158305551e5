"""Column expressions on connection fields: text, addresses, time, flags."""

from __future__ import annotations

import ipaddress
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborwatch.schema import NOT_FAILED_STATES

# IPv4 ranges that are not globally reachable.
NON_GLOBAL_RANGES = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]


def _global_ranges() -> list[tuple[int, int]]:
    """(first address, addresses in all earlier ranges) of the global ranges, in order; the last entry has the total."""
    blocked = sorted((int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, NON_GLOBAL_RANGES))
    ranges, begin, total = [], 0, 0
    for low, high in [*blocked, (1 << 32, 1 << 32)]:
        if low > begin:
            ranges.append((begin, total))
            total += low - begin
        begin = max(begin, high + 1)
    return [*ranges, (1 << 32, total)]


GLOBAL_RANGES = _global_ranges()
GLOBAL_ADDRESSES = GLOBAL_RANGES[-1][1]


# --- text ------------------------------------------------------------------

def null_dash(c: Column) -> Column:
    """``-`` means the field is unset."""
    return F.nullif(c, F.lit("-"))


def measure(c: Column) -> Column:
    return null_dash(c).try_cast("double")


# --- addresses -------------------------------------------------------------

def is_ipv6(ip: Column) -> Column:
    return F.contains(ip, F.lit(":"))


def subnet24(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit("."))


def subnet16(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 2), F.lit("."))


def ip_number(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(octets, F.lit(i)).try_cast("long")
    return number


def ip_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def in_cidr(number: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr)
    host_bits = 32 - net.prefixlen
    return F.shiftright(number, host_bits) == F.lit(int(net.network_address) >> host_bits)


def is_global(number: Column) -> Column:
    blocked = F.lit(False)
    for cidr in NON_GLOBAL_RANGES:
        blocked = blocked | in_cidr(number, cidr)
    return ~blocked


def random_public_ip(seed: str, *keys: Column) -> Column:
    """Stable pseudo-random global IPv4 address of the key columns.

    60 bits of md5(seed, keys) choose one of all global addresses in order, each with the same chance.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *keys))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(GLOBAL_ADDRESSES)

    def address(i: Column) -> Column:
        number = i + GLOBAL_RANGES[0][0]
        for first, earlier in GLOBAL_RANGES[1:-1]:
            number = F.when(i >= earlier, i - earlier + first).otherwise(number)
        return number

    # Arrays of one entry: each step is evaluated once.
    number = F.transform(F.array(place), address)
    return F.get(F.transform(number, ip_text), F.lit(0))


def seeded_order(seed: str, *keys: Column) -> Column:
    """Order-by key that stands for a random choice but is the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


# --- time ------------------------------------------------------------------

def local_wallclock(ts: Column, tz: str) -> Column:
    """Epoch seconds -> the zone's wall clock, expressed as if it were UTC."""
    if tz == "UTC":
        return ts
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_seconds(ts), tz)) / F.lit(1e6)


def local_day(ts: Column, tz: str) -> Column:
    return F.date_from_unix_date(F.floor(local_wallclock(ts, tz) / 86400).cast("int"))


def time_window(ts: Column, tz: str, tw_seconds: int) -> Column:
    """Index of the tumbling window within the local day."""
    return F.floor(F.floor(F.pmod(local_wallclock(ts, tz), F.lit(86400.0))) / tw_seconds).cast("int")


def day_bounds(day: date, tz: str, days: int = 1) -> tuple[float, float]:
    """[start, end) epoch seconds of a local day: a range the file scan can push down."""
    zone = ZoneInfo(tz)
    last = day + timedelta(days=days)
    start, end = (datetime(d.year, d.month, d.day, tzinfo=zone) for d in (day, last))
    return start.timestamp(), end.timestamp()


def epoch_to_timestamp(ts: Column) -> Column:
    return F.timestamp_micros(F.round(ts * F.lit(1e6)).cast("long"))


def timestamp_to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def apply_time_offset(ts: Column, start: Column, end: Column, fraction: float) -> Column:
    """ts moved by a fraction of [start, end); NULL when it falls past the end."""
    moved = ts + F.lit(fraction) * (end - start)
    return F.when(moved <= end, moved)


INTERVAL_PATTERN = r"^(\d{4})(\d{2})(\d{2})_(\d{2}):(\d{2}):(\d{2})-(\d{2}):(\d{2}):(\d{2})-(\d{2})(\d{2})$"


def interval_to_utc(interval: Column) -> Column:
    """``YYYYMMDD_HH:MM:SS-HH:MM:SS-HHMM`` -> struct of start, end (UTC epoch) and local start, end.

    An end of 00:00:00 is the next midnight for the UTC end. Text with a ``+`` offset, or any other
    shape, gives NULL.
    """
    part = [F.regexp_extract(interval, INTERVAL_PATTERN, i).try_cast("int") for i in range(1, 12)]
    midnight = F.unix_date(F.make_date(part[0], part[1], part[2])).cast("double") * 86400
    start = midnight + (part[3] * 3600 + part[4] * 60 + part[5]).cast("double")
    end_of_day = (part[6] * 3600 + part[7] * 60 + part[8]).cast("double")
    end = midnight + end_of_day
    offset = (part[9] * 3600 + part[10] * 60).cast("double")
    next_day = F.when(end_of_day == 0, F.lit(86400.0)).otherwise(F.lit(0.0))
    return F.when(
        F.regexp_like(interval, F.lit(INTERVAL_PATTERN)),
        F.struct((start + offset).alias("start_utc"), (end + offset + next_day).alias("end_utc"),
                 start.alias("start_local"), end.alias("end_local")),
    )


# --- flags -----------------------------------------------------------------

def failed_flag(state: Column) -> Column:
    """Unset states do not count as failed."""
    return F.coalesce(~state.isin(NOT_FAILED_STATES), F.lit(False))


def zero_resp_flag(resp_bytes: Column) -> Column:
    return F.coalesce(resp_bytes == 0, F.lit(False))


def utc(year: int, month: int, day: int) -> float:
    return datetime(year, month, day, tzinfo=timezone.utc).timestamp()
