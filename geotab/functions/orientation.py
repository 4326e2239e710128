"""Orientation of planes and lines as Column expressions.

Angles are in degrees. Normals point down (z <= 0); dip is 0 to 90, directions are 0 to 360.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

DEG = 180 / pi


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def wrap360(a) -> Column:
    """Angle in [0, 360), also where rounding would give 360."""
    p = F.pmod(_c(a), F.lit(360.0))
    return F.when(p >= 360.0, F.lit(0.0)).otherwise(p)


def angle_wrap(a) -> Column:
    """Radians in [0, 2 pi)."""
    return F.pmod(_c(a), F.lit(2 * pi))


def strike_to_dipdir(strike) -> Column:
    s = _c(strike)
    return F.when(s <= 270, s + 90).otherwise(s - 270)


def vector(plunge, trend) -> tuple[Column, Column, Column]:
    """Unit vector of a line, pointing down for positive plunge."""
    p, t = F.radians(_c(plunge)), F.radians(_c(trend))
    return F.sin(t) * F.cos(p), F.cos(t) * F.cos(p), -F.sin(p)


def normal(dip, dip_dir) -> tuple[Column, Column, Column]:
    """Downward unit normal of a plane."""
    return vector(90 - _c(dip), _c(dip_dir) - 180)


def down(x, y, z) -> tuple[Column, Column, Column]:
    """The vector, turned so that z is not positive."""
    up = _c(z) > 0
    return tuple(F.when(up, -_c(v)).otherwise(_c(v)) for v in (x, y, z))


def dip(nz) -> Column:
    return 90 - F.degrees(F.asin(_unit(-_c(nz))))


def dip_direction(nx, ny) -> Column:
    return wrap360(F.degrees(F.atan2(_c(nx), _c(ny))) - 180)


def trend(lx, ly) -> Column:
    return F.degrees(F.atan2(_c(lx), _c(ly)))


def plunge(lz) -> Column:
    return F.degrees(F.asin(_unit(-_c(lz))))


def dip_frame(nx, ny, nz) -> tuple[tuple, tuple]:
    """Horizontal direction vector (ny, -nx, 0) and the dip vector, its product with the normal."""
    a, b, c = _c(nx), _c(ny), _c(nz)
    return (b, -a, F.lit(0.0)), (a * c, b * c, -(a * a) - b * b)


def apparent_dip(dip_, dip_dir, strike) -> Column:
    """Dip of a plane seen along a section of this strike."""
    return F.degrees(F.atan(F.tan(F.radians(_c(dip_))) * F.cos(F.radians(_c(dip_dir) - _c(strike)))))


def apparent_plunge(plunge_, trend_, strike) -> Column:
    """Plunge of a line projected on a vertical section of this strike."""
    return F.degrees(F.atan2(F.sin(F.radians(_c(plunge_))), F.cos(F.radians(_c(plunge_))) * F.cos(F.radians(_c(trend_) - _c(strike)))))


def section_basis(strike, dip_) -> tuple[tuple, tuple, tuple]:
    """Unit vectors along strike, down dip, and their product, the normal of a section."""
    s, d = F.radians(_c(strike)), F.radians(_c(dip_))
    q = F.radians(_c(strike) + 90)
    u = (F.sin(s), F.cos(s), F.lit(0.0))
    v = (F.sin(q) * F.cos(d), F.cos(q) * F.cos(d), -F.sin(d))
    return u, v, cross(u, v)


def cross(a, b) -> tuple[Column, Column, Column]:
    (a0, a1, a2), (b0, b1, b2) = [tuple(map(_c, t)) for t in (a, b)]
    return a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0


def dot(a, b) -> Column:
    (a0, a1, a2), (b0, b1, b2) = [tuple(map(_c, t)) for t in (a, b)]
    return a0 * b0 + a1 * b1 + a2 * b2


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def rotate(v, axis: str, angle) -> tuple[Column, Column, Column]:
    """Row vector times the rotation about a coordinate axis by angle."""
    x, y, z = map(_c, v)
    c, s = F.cos(F.radians(_c(angle))), F.sin(F.radians(_c(angle)))
    if axis == "x":
        return x, y * c + z * s, z * c - y * s
    if axis == "y":
        return x * c - z * s, y, x * s + z * c
    if axis == "z":
        return x * c + y * s, y * c - x * s, z
    raise ValueError("axis must be x, y or z")


def measure(dx, dy, dz) -> tuple[Column, Column, Column]:
    """Length, azimuth and dip of a vector; a zero vector has null dip."""
    x, y, z = _c(dx), _c(dy), _c(dz)
    length = F.sqrt(x * x + y * y + z * z)
    return length, wrap360(F.degrees(F.atan2(x, y))), F.degrees(F.asin(_unit(F.try_divide(F.abs(z), length))))


def stereonet(x, y, z, kind: str = "equal_area") -> tuple[Column, Column]:
    """Lower-hemisphere projection of a downward unit vector onto the unit disc."""
    a, b, c = _c(x), _c(y), _c(z)
    if kind == "equal_area":
        k = F.sqrt(F.try_divide(F.lit(1.0), 1 - c))
    elif kind == "equal_angle":
        k = F.try_divide(F.lit(1.0), 1 - c)
    else:
        raise ValueError("kind must be equal_area or equal_angle")
    return a * k, b * k
