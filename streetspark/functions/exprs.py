"""Column expressions for planar quadratic curves, bearings and affine maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(p0, p1, p2, t) -> Column:
    """A coordinate of the curve at t."""
    p0, p1, p2, t = map(col, (p0, p1, p2, t))
    s = F.lit(1.0) - t
    return s * s * p0 + F.lit(2.0) * s * t * p1 + t * t * p2


def derivative(p0, p1, p2, t) -> Column:
    p0, p1, p2, t = map(col, (p0, p1, p2, t))
    return F.lit(2.0) * ((F.lit(1.0) - t) * (p1 - p0) + t * (p2 - p1))


def split(p0, p1, p2, t) -> tuple[Column, Column, Column]:
    """De Casteljau at t: the left piece's control coordinate, the split coordinate, the right piece's."""
    p0, p1, p2, t = map(col, (p0, p1, p2, t))
    a, b = p0 + t * (p1 - p0), p1 + t * (p2 - p1)
    return a, a + t * (b - a), b


def bounds(p0, p1, p2) -> tuple[Column, Column]:
    """Least and largest coordinate: the ends, and the inner extremum where there is one."""
    p0, p1, p2 = map(col, (p0, p1, p2))
    d = p0 - F.lit(2.0) * p1 + p2
    t = F.when(d != 0, (p0 - p1) / F.when(d != 0, d))
    inner = F.when((t > 0) & (t < 1), point(p0, p1, p2, t))
    return F.least(p0, p2, inner), F.greatest(p0, p2, inner)


def cross(ax, ay, bx, by) -> Column:
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    return ax * by - ay * bx


def norm(x, y) -> Column:
    x, y = col(x), col(y)
    return F.sqrt(x * x + y * y)


def wrap(v, period: float = 360.0) -> Column:
    """v modulo the period, in [0, period)."""
    v = col(v)
    out = v - F.lit(period) * F.floor(v / F.lit(period))
    return F.when(out >= period, F.lit(0.0)).otherwise(out)


def bearing(dx, dy) -> Column:
    """Degrees from +y towards +x; null if both are 0."""
    dx, dy = col(dx), col(dy)
    return F.when((dx != 0) | (dy != 0), wrap(F.degrees(F.atan2(dx, dy))))


def reciprocal(b) -> Column:
    return wrap(col(b) + F.lit(180.0))


def bin_index(b, bins: int = 36, offset=0.0) -> Column:
    """Number of the bin whose centre is nearest; bin 0 is centred at the offset (modulo a bin's width)."""
    width = 360.0 / bins
    off = wrap(F.lit(offset) if isinstance(offset, (int, float)) else offset, width)
    return F.pmod(F.floor(wrap(col(b) - off + F.lit(width / 2)) / F.lit(width)), F.lit(bins)).cast("int")


def affine(v, low, size, extent, origin) -> Column:
    """A map coordinate on a terrain: origin + (v - low) / size * extent."""
    v, low, size, extent, origin = map(col, (v, low, size, extent, origin))
    return origin + (v - low) / size * extent


def overlap(a: str, b: str, padding: float = 0.0) -> Column:
    """Closed overlap of two boxes (min_x, max_x, min_y, max_y under aliases a and b)."""
    out = F.lit(True)
    for c in AXES:
        out = out & (F.col(f"{a}.min_{c}") - padding <= F.col(f"{b}.max_{c}")) & (F.col(f"{b}.min_{c}") - padding <= F.col(f"{a}.max_{c}"))
    return out


def strict_boolean(c) -> Column:
    """'True' or 'False'; anything else is an error."""
    c = col(c)
    wrong = F.raise_error(F.concat(F.lit("neither True nor False: "), F.coalesce(c, F.lit("null")))).cast("boolean")
    return F.when(c == "True", F.lit(True)).when(c == "False", F.lit(False)).otherwise(wrong)
