"""Plane geometry as Column expressions; segments are (ax, ay)-(bx, by) and (cx, cy)-(dx, dy)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Sign of the cross product (q - p) x (r - p): 1 left, -1 right, 0 straight on."""
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px)).cast("int")


def _between(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Whether r, known to be on the line through p and q, lies within their box."""
    return rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments have a point in common; touching and overlapping count."""
    t1, t2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    t3, t4 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    return (
        ((t1 != t2) & (t3 != t4))
        | ((t1 == 0) & _between(ax, ay, bx, by, cx, cy))
        | ((t2 == 0) & _between(ax, ay, bx, by, dx, dy))
        | ((t3 == 0) & _between(cx, cy, dx, dy, ax, ay))
        | ((t4 == 0) & _between(cx, cy, dx, dy, bx, by))
    )


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments cross inside both; touching ends don't count."""
    return (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)


def crossing_share(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Where on the first segment (0 .. 1) the second one's line cuts it; null when parallel."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    return F.when(den != 0, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den)


def length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
