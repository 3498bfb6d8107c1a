"""Distances, speeds and sectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_NM = 6_371_000.0 / 1852.0


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in nautical miles; the root is clamped at 1 against rounding near antipodes."""
    lat1, lon1, lat2, lon2 = (F.col(x) if isinstance(x, str) else x for x in (lat1, lon1, lat2, lon2))
    u = F.sin(F.radians(lat2 - lat1) / 2)
    v = F.sin(F.radians(lon2 - lon1) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2 * EARTH_RADIUS_NM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def elapsed_s(start, end) -> Column:
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.unix_seconds(end) - F.unix_seconds(start)


def hours_between(start, end) -> Column:
    return elapsed_s(start, end) / 3600.0


def implied_speed_kn(distance_nm: Column, seconds: Column) -> Column:
    """Null when no time has passed."""
    return F.when(seconds > 0, distance_nm / (seconds / 3600.0))


def overlap_s(from1, to1, from2, to2) -> Column:
    """Shared seconds of two intervals; below zero it is the gap between them, and null where any end is unknown."""
    from1, to1, from2, to2 = (F.col(x) if isinstance(x, str) else x for x in (from1, to1, from2, to2))
    known = from1.isNotNull() & to1.isNotNull() & from2.isNotNull() & to2.isNotNull()
    return F.when(known, F.unix_seconds(F.least(to1, to2)) - F.unix_seconds(F.greatest(from1, from2)))


def heading_arrow(course: Column) -> Column:
    """Arrow of the nearest of eight sectors; a dot where the course is unknown."""
    arrows = F.array(*[F.lit(a) for a in "↑↗→↘↓↙←↖"])
    sector = F.pmod(F.bround(F.pmod(course, F.lit(360.0)) / 45.0).cast("int"), F.lit(8))
    return F.coalesce(F.get(arrows, sector), F.lit("•"))


#: The named waters, as (least latitude, greatest latitude, least longitude, greatest longitude).
REGIONS = {
    "danish-waters": (54.3, 58.2, 7.6, 13.4),
    "kattegat": (55.9, 57.9, 10.1, 12.9),
    "skagerrak": (57.0, 59.3, 7.6, 11.6),
    "belts": (54.8, 56.0, 9.5, 11.5),
    "oresund": (55.3, 56.2, 12.2, 13.1),
}


def in_region(name: str, lat="lat", lon="lon") -> Column:
    """Inside a named box, edges included; names ignore case."""
    if name.lower() not in REGIONS:
        raise ValueError(f"no region {name!r}; there are {', '.join(sorted(REGIONS))}")
    south, north, west, east = REGIONS[name.lower()]
    lat, lon = (F.col(x) if isinstance(x, str) else x for x in (lat, lon))
    return lat.between(south, north) & lon.between(west, east)
