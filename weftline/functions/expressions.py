"""Column expressions: rounding, canonical pairs, hashes, distances and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: Column | str, places: int = 4) -> Column:
    """Rounds a non-negative double; the floor form is the same in every engine."""
    scale = float(10**places)
    return F.floor(_c(x).cast("double") * scale + 0.5) / F.lit(scale)


def canonical_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))


def edge_key(a: Column | str, b: Column | str, shard_separator: str | None = None) -> Column:
    """md5 of "smaller->larger"; with a shard separator, ids of shard:key form give shard:md5:shard."""
    low, high = canonical_pair(a, b)
    digest = F.md5(F.concat(low, F.lit("->"), high))
    if shard_separator is None:
        return digest
    shard = lambda c: F.split_part(c, F.lit(shard_separator), F.lit(1))
    return F.concat_ws(shard_separator, shard(low), digest, shard(high))


def signature(*parts: Column | str, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[_c(p) for p in parts]), 256), 1, length)


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str, radius: float = 6371.0) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def within_km(lat1, lon1, lat2, lon2, limit: float) -> Column:
    """True within the limit, and where a coordinate is missing."""
    return F.coalesce(haversine_km(lat1, lon1, lat2, lon2) <= limit, F.lit(True))


def parse_date(x: Column | str) -> Column:
    """A date from yyyy-MM-dd, yyyy/MM/dd, MM/dd/yyyy or a bare year; null if none fits."""
    s = F.trim(_c(x).cast("string"))
    shaped = lambda pattern, form: F.when(s.rlike(pattern), F.try_to_date(s, form))
    return F.coalesce(
        shaped(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), shaped(r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), shaped(r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), shaped(r"^\d{4}$", "yyyy")
    )


def within_days(a, b, limit: int = 365) -> Column:
    """True within the limit, and where a date is missing or can't be read."""
    return F.coalesce(F.abs(F.datediff(parse_date(a), parse_date(b))) <= limit, F.lit(True))
