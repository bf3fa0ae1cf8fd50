"""Polygons, rectangles and image plans as column expressions.

A ring is a flat array [x0, y0, x1, y1, ...]; a segmentation is an array of
rings, the first one the outline, the others holes.  ``points`` means an array
of structs (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segstats.functions.scalar import hash_int, hash_uniform, let


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_points(ring: Column) -> Column:
    """Flat ring to an array of (x, y).  The ring is bound first: a lambda would make it anew for every vertex."""
    def points(r: Column) -> Column:
        n = F.floor(F.size(r) / 2).cast("int")
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(index, lambda i: _point(F.get(r, 2 * i), F.get(r, 2 * i + 1)))

    return let(ring, points)


def flat_ring(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def _next(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i + 1, F.size(points)))


def _previous(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i - 1, F.size(points)))


def points_area(points: Column) -> Column:
    """Absolute shoelace area."""
    def shoelace(pts: Column) -> Column:
        terms = F.transform(pts, lambda p, i: p["x"].cast("double") * _next(pts, i)["y"] - _next(pts, i)["x"].cast("double") * p["y"])
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2.0

    return let(points, shoelace)


def polygon_area(ring: Column) -> Column:
    return points_area(ring_points(ring))


def area_with_holes(segmentation: Column) -> Column:
    """Outline area minus the area of every hole."""
    holes = F.slice(segmentation, 2, F.greatest(F.size(segmentation) - 1, F.lit(0)))
    return polygon_area(F.get(segmentation, F.lit(0))) - F.aggregate(
        F.transform(holes, polygon_area), F.lit(0.0), lambda s, v: s + v)


def polygon_bbox(ring: Column) -> Column:
    """Struct (x0, y0, x1, y1) of coordinate extremes."""
    xs = F.filter(ring, lambda _, i: i % 2 == 0)
    ys = F.filter(ring, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bbox_xywh(ring: Column, inclusive: bool = False) -> Column:
    """[x, y, w, h]; ``inclusive`` counts pixels (max - min + 1) instead of extent."""
    box, extra = polygon_bbox(ring), 1 if inclusive else 0
    return F.array(box["x0"], box["y0"], box["x1"] - box["x0"] + extra, box["y1"] - box["y0"] + extra)


def clamp_polygon(ring: Column, width: Column, height: Column) -> Column:
    """Clip every vertex coordinate to the canvas."""
    return F.transform(ring, lambda v, i: F.greatest(
        F.lit(0), F.least(v, F.when(i % 2 == 0, width - 1).otherwise(height - 1))))


def is_axis_rect(ring: Column) -> Column:
    """Four vertices on two distinct x and two distinct y values (truncated)."""
    def test(points: Column) -> Column:
        xs = F.array_distinct(F.transform(points, lambda p: p["x"].cast("bigint")))
        ys = F.array_distinct(F.transform(points, lambda p: p["y"].cast("bigint")))
        return (F.size(points) == 4) & (F.size(xs) == 2) & (F.size(ys) == 2)

    return let(ring_points(ring), test)


def dedupe_vertices(ring: Column) -> Column:
    """Round (half to even), drop consecutive repeats and the closing repeat."""
    points = F.transform(ring_points(ring), lambda p: _point(F.rint(p["x"].cast("double")).cast("bigint"),
                                                            F.rint(p["y"].cast("double")).cast("bigint")))
    kept = let(points, lambda pts: F.filter(pts, lambda p, i: (i == 0) | (p != F.get(pts, i - 1))))

    def opened(pts: Column) -> Column:
        closed = (F.size(pts) > 1) & (F.get(pts, F.lit(0)) == F.get(pts, F.size(pts) - 1))
        return F.when(closed, F.slice(pts, 1, F.size(pts) - 1)).otherwise(pts)

    return flat_ring(let(kept, opened))


def simplify_rectilinear(ring: Column) -> Column:
    """Drop repeated vertices and those inside a straight horizontal or vertical run."""
    def corners(points: Column) -> Column:
        def turns(p: Column, i: Column) -> Column:
            a, c = _previous(points, i), _next(points, i)
            return ~(((a["x"] == p["x"]) & (p["x"] == c["x"])) | ((a["y"] == p["y"]) & (p["y"] == c["y"])))

        return F.when(F.size(points) < 3, points).otherwise(F.filter(points, turns))

    distinct = let(ring_points(ring), lambda raw: F.filter(raw, lambda p, i: p != _previous(raw, i)))
    return flat_ring(let(distinct, corners))


def translate(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))


def translate_box(box: Column, dx: Column, dy: Column) -> Column:
    return F.struct((box["x0"] + dx).alias("x0"), (box["y0"] + dy).alias("y0"),
                    (box["x1"] + dx).alias("x1"), (box["y1"] + dy).alias("y1"))


def flip_rot90(x: Column, y: Column, width: Column, height: Column, hflip: Column, vflip: Column, k: Column) -> Column:
    """Pixel after a horizontal flip, a vertical flip and k counter-clockwise quarter turns.

    Returns struct (x, y, width, height); odd k swaps the canvas sides.
    """
    fx = F.when(hflip, width - 1 - x).otherwise(x)
    fy = F.when(vflip, height - 1 - y).otherwise(y)
    turns = F.pmod(k, F.lit(4))
    nx = F.when(turns == 0, fx).when(turns == 1, fy).when(turns == 2, width - 1 - fx).otherwise(height - 1 - fy)
    ny = F.when(turns == 0, fy).when(turns == 1, width - 1 - fx).when(turns == 2, height - 1 - fy).otherwise(fx)
    odd = turns % 2 == 1
    return F.struct(nx.alias("x"), ny.alias("y"), F.when(odd, height).otherwise(width).alias("width"),
                    F.when(odd, width).otherwise(height).alias("height"))


def resize_plan(height: Column, width: Column, max_size: int) -> Column:
    """Struct (scale, nh, nw) of an aspect-keeping resize; sizes rounded half to even."""
    scale = F.lit(float(max_size)) / F.greatest(height, width)
    return F.struct(scale.alias("scale"), F.greatest(F.lit(1), F.rint(height * scale)).cast("bigint").alias("nh"),
                    F.greatest(F.lit(1), F.rint(width * scale)).cast("bigint").alias("nw"))


def rect_intersection_area(ax0: Column, ay0: Column, ax1: Column, ay1: Column,
                           bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Overlap area of two continuous rectangles, 0 when they only touch."""
    zero = F.lit(0)
    return F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(
        zero, F.least(ay1, by1) - F.greatest(ay0, by0))


def box_iou(ax0: Column, ay0: Column, ax1: Column, ay1: Column,
            bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """IoU of two boxes whose ends are pixels inside the box."""
    inter = rect_intersection_area(ax0, ay0, ax1 + 1, ay1 + 1, bx0, by0, bx1 + 1, by1 + 1)
    union = (ax1 - ax0 + 1) * (ay1 - ay0 + 1) + (bx1 - bx0 + 1) * (by1 - by0 + 1) - inter
    return inter.cast("double") / F.greatest(union, F.lit(1)).cast("double")


def edge_on_rect_perimeter(ex0: Column, ey0: Column, ex1: Column, ey1: Column,
                           rx0: Column, ry0: Column, rx1: Column, ry1: Column) -> Column:
    """An axis-aligned edge lies on the outline of a rectangle, over more than a point."""
    upright = ((ex0 == rx0) | (ex0 == rx1)) & (
        F.greatest(F.least(ey0, ey1), ry0) < F.least(F.greatest(ey0, ey1), ry1))
    level = ((ey0 == ry0) | (ey0 == ry1)) & (
        F.greatest(F.least(ex0, ex1), rx0) < F.least(F.greatest(ex0, ex1), rx1))
    return F.when(ex0 == ex1, upright).when(ey0 == ey1, level).otherwise(F.lit(False))


def _point_in(x: Column, y: Column, points: Column) -> Column:
    def crosses(p: Column, i: Column) -> Column:
        q = _previous(points, i)
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"] + F.lit(1e-9)) + p["x"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    return F.size(F.filter(points, crosses)) % 2 == 1


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast; 1e-9 keeps the slope finite."""
    return let(ring_points(ring), lambda points: _point_in(x, y, points))


def rect_in_ring(x: Column, y: Column, w: Column, h: Column, ring: Column, margin: int = 8) -> Column:
    """All four corners of the rectangle, grown by ``margin``, are inside the ring."""
    left, top, right, bottom = x - margin, y - margin, x + w + margin, y + h + margin
    return let(ring_points(ring), lambda points: _point_in(left, top, points) & _point_in(right, top, points)
               & _point_in(right, bottom, points) & _point_in(left, bottom, points))


def strip_tiles(x0: Column, y0: Column, x1: Column, y1: Column, n: Column, seed: int, key: Column,
                min_bay: int = 60) -> Column:
    """Array of strips (x0, y0, x1, y1) along the long side of a rectangle.

    Inner cuts are evenly spaced and moved by a hash draw of up to a fifth of a strip.
    """
    w, h = x1 - x0, y1 - y0
    across = w >= h
    span = F.when(across, w).otherwise(h)
    count = F.greatest(F.lit(1), F.least(n, F.floor(span / min_bay))).cast("int")
    start = F.when(across, x0).otherwise(y0)
    shift = F.greatest(F.lit(1), F.floor(span / (5 * count)))
    cuts = F.array_sort(F.transform(
        F.sequence(F.lit(0), count),
        lambda i: start + F.floor(span * i / count).cast("bigint") + F.when((i == 0) | (i == count), F.lit(0)).otherwise(
            hash_int(-shift, shift, hash_uniform(seed, key, i)))))
    return let(cuts, lambda c: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        F.when(across, F.get(c, i)).otherwise(x0).alias("x0"),
        F.when(across, y0).otherwise(F.get(c, i)).alias("y0"),
        F.when(across, F.get(c, i + 1)).otherwise(x1).alias("x1"),
        F.when(across, y1).otherwise(F.get(c, i + 1)).alias("y1"))))


def patch_index(height: Column, width: Column, block: int, stride: int) -> Column:
    """Array of patch origins (y, x) at a stride; one origin (0, 0) when nothing fits."""
    ys = F.when(height >= block, F.sequence(F.lit(0).cast("bigint"), (height - block).cast("bigint"), F.lit(stride).cast("bigint")))
    xs = F.when(width >= block, F.sequence(F.lit(0).cast("bigint"), (width - block).cast("bigint"), F.lit(stride).cast("bigint")))
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: _yx(y, x))))
    zero = F.lit(0).cast("bigint")
    return F.coalesce(grid, F.array(_yx(zero, zero)))


def _yx(y: Column, x: Column) -> Column:
    return F.struct(y.alias("y"), x.alias("x"))
