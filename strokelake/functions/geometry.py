"""Segment geometry as Column expressions; everything stays in generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from strokelake.config import TOLERANCE, MatchTolerance


class Seg(NamedTuple):
    """The four end-point columns of a segment."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column


def seg(prefix: str = "") -> Seg:
    return Seg(*(F.col(f"{prefix}{name}") for name in Seg._fields))


def seg_length(s: Seg) -> Column:
    return F.sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))


def seg_angle(s: Seg) -> Column:
    return F.degrees(F.atan2((s.y2 - s.y1).cast("double"), (s.x2 - s.x1).cast("double")))


def undirected_angle(angle: Column, mod: int = 90) -> Column:
    """Fold an angle in degrees to 0-90, or to 0-180 with ``mod=180``."""
    if mod == 180:
        return F.pmod(angle, F.lit(180.0))
    return F.when(F.abs(angle) > 90, 180 - F.abs(angle)).otherwise(F.abs(angle))


def orientation(angle: Column) -> Column:
    folded = undirected_angle(angle)
    return F.when(folded < 15, "horizontal").when(folded > 75, "vertical").otherwise("diagonal")


def midpoint(s: Seg) -> tuple[Column, Column]:
    return (s.x1 + s.x2) / 2.0, (s.y1 + s.y2) / 2.0


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def mid_distance(a: Seg, b: Seg) -> Column:
    return distance(*midpoint(a), *midpoint(b))


def angle_gap(a: Column, b: Column) -> Column:
    """Gap of two directed angles in degrees, wrapped at 180."""
    gap = F.abs(a - b)
    return F.when(gap > 180, 360 - gap).otherwise(gap)


def position_similarity(a: Seg, b: Seg, tol: MatchTolerance = TOLERANCE) -> Column:
    return F.greatest(F.lit(0.0), 1 - mid_distance(a, b) / tol.position)


def angle_similarity(a: Seg, b: Seg, tol: MatchTolerance = TOLERANCE, undirected: bool = False) -> Column:
    gap = angle_gap(seg_angle(a), seg_angle(b))
    if undirected:
        gap = F.least(gap, 180 - gap)
    return F.greatest(F.lit(0.0), 1 - gap / tol.angle)


def length_similarity(a: Seg, b: Seg, tol: MatchTolerance = TOLERANCE) -> Column:
    la, lb = seg_length(a), seg_length(b)
    ratio = F.least(la, lb) / F.greatest(la, lb)
    floor = 1 - tol.length
    return F.when((la > 0) & (lb > 0), F.greatest(F.lit(0.0), (ratio - floor) / tol.length)).otherwise(0.0)


def line_similarity(a: Seg, b: Seg, tol: MatchTolerance = TOLERANCE, undirected: bool = False) -> Column:
    return (
        tol.w_position * position_similarity(a, b, tol)
        + tol.w_angle * angle_similarity(a, b, tol, undirected)
        + tol.w_length * length_similarity(a, b, tol)
    )


def point_line_distance(px: Column, py: Column, s: Seg) -> Column:
    """Distance to the infinite line through ``s``; to its point when ``s`` has no length."""
    length = seg_length(s)
    across = F.abs((s.y2 - s.y1) * px - (s.x2 - s.x1) * py + s.x2 * s.y1 - s.y2 * s.x1)
    return F.when(length == 0, distance(px, py, s.x1, s.y1)).otherwise(across / length)


def point_segment_distance(px: Column, py: Column, s: Seg) -> Column:
    """Distance to the nearest point of the closed segment."""
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    square = dx * dx + dy * dy
    along = F.when(square == 0, 0.0).otherwise(((px - s.x1) * dx + (py - s.y1) * dy) / square)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(px, py, s.x1 + t * dx, s.y1 + t * dy)


def _turns_left(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(a: Seg, b: Seg) -> Column:
    """End points of each segment lie on different sides of the other."""
    p, q = (a.x1, a.y1), (a.x2, a.y2)
    r, s = (b.x1, b.y1), (b.x2, b.y2)
    return (_turns_left(*p, *r, *s) != _turns_left(*q, *r, *s)) & (
        _turns_left(*p, *q, *r) != _turns_left(*p, *q, *s)
    )


def affine(
    x: Column, y: Column, centre: tuple[float, float], degrees: Column, scale: Column, tx: Column, ty: Column
) -> tuple[Column, Column]:
    """Rotate and scale about a centre (image axes, y down), then shift."""
    cx, cy = F.lit(float(centre[0])), F.lit(float(centre[1]))
    a, b = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    return (
        a * (x - cx) + b * (y - cy) + cx + tx,
        -b * (x - cx) + a * (y - cy) + cy + ty,
    )


def read_transform(a: Column, b: Column, tx: Column, c: Column, d: Column, ty: Column) -> dict[str, Column]:
    """Shift, rotation and scale of a 2x3 matrix ``[[a, b, tx], [c, d, ty]]``."""
    scale_x, scale_y = F.sqrt(a * a + b * b), F.sqrt(c * c + d * d)
    return {
        "translation_x": tx,
        "translation_y": ty,
        "rotation_degrees": F.degrees(F.atan2(b, a)),
        "scale_x": scale_x,
        "scale_y": scale_y,
        "scale": (scale_x + scale_y) / 2.0,
    }


def shorten(s: Seg, factor: Column) -> Seg:
    """Pull both ends towards the midpoint; coordinates truncate to whole pixels."""
    mx, my = midpoint(s)
    return Seg(
        (mx + (s.x1 - mx) * factor).cast("int"),
        (my + (s.y1 - my) * factor).cast("int"),
        (mx + (s.x2 - mx) * factor).cast("int"),
        (my + (s.y2 - my) * factor).cast("int"),
    )


def clip(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clip_segment(s: Seg, width: int, height: int) -> Seg:
    return Seg(clip(s.x1, 0, width - 1), clip(s.y1, 0, height - 1), clip(s.x2, 0, width - 1), clip(s.y2, 0, height - 1))


def bezier_steps(s: Seg) -> Column:
    return F.greatest(F.lit(10), (seg_length(s) / 10).cast("int"))


def bezier_at(s: Seg, curvature: Column, t: Column) -> tuple[Column, Column]:
    """Point of the quadratic curve whose control point sits off the midpoint by length x curvature."""
    length = seg_length(s)
    mx, my = midpoint(s)
    cx = mx - (s.y2 - s.y1) / length * (length * curvature)
    cy = my + (s.x2 - s.x1) / length * (length * curvature)
    u = 1 - t
    return (
        (u * u * s.x1 + 2 * u * t * cx + t * t * s.x2).cast("int"),
        (u * u * s.y1 + 2 * u * t * cy + t * t * s.y2).cast("int"),
    )


def fit_scale(width: Column, height: Column, target_w: int, target_h: int) -> Column:
    return F.least(target_w / width, target_h / height)
