"""Column functions on coordinates: bands, distance bins, deterministic uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x: Column | str = "start1", y: Column | str = "start2") -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.abs(x - y)


def in_band(low: int, high: int, x: str = "start1", y: str = "start2") -> Column:
    """low <= x - y < high."""
    d = F.col(x) - F.col(y)
    return (d >= low) & (d < high)


def beyond(min_dist: int, inclusive: bool = False) -> Column:
    """Contacts farther from the diagonal than ``min_dist``: scoring is strict, shuffling inclusive."""
    return distance() >= min_dist if inclusive else distance() > min_dist


def min_distance_bin(resolution: int, min_dist: int) -> int:
    import math

    return max(0, int(resolution * math.log2(min_dist))) if min_dist > 0 else 0


def distance_bin(resolution: int, min_dist: int, x: Column | str = "start1", y: Column | str = "start2") -> Column:
    """floor(resolution * log2(1 + |x - y|)) less the bin of ``min_dist``; -1 where that is negative."""
    raw = F.floor(F.log(1 + distance(x, y).cast("double")) / F.log(F.lit(2.0)) * resolution) - min_distance_bin(resolution, min_dist)
    return F.when(raw < 0, -1).otherwise(raw).cast("long")


def hash_uniform(*parts: Column | str) -> Column:
    """A uniform in [0, 1) from the first 28 bits of the md5 of the parts joined by ':'."""
    return hash28(*parts) / F.lit(float(1 << 28))


def hash28(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 7), 16, 10).cast("long")


def log_grid_bin(width: int, resolution: int, min_dist: int, x: str = "start1", y: str = "start2") -> tuple[Column, Column]:
    """A contact's place in a grid of midpoints, ``width`` wide, and log distances."""
    return F.floor((F.col(x) + F.col(y)) / 2 / width), distance_bin(resolution, min_dist, x, y)
