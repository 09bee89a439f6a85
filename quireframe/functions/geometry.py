"""Page geometry as column expressions.  Points, origin bottom-left, Y up, unrotated, unless a name says *visual*."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VISIBLE_SLACK = 0.5
# Raster and page limits.
MAX_BITMAP_PIXELS = 8_000_000
MAX_BITMAP_SIDE = 16384
MAX_PAGE_SIDE_PT = 14400
BOUND_MARGIN = 0.999
MAX_SHARPNESS = 2.5
SUBSTITUTE_W, SUBSTITUTE_H = 595.0, 842.0
ASCENT, DESCENT = 0.72, 0.2


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def is_visible(x: Column, y: Column, w: Column, h: Column, ox: Column, oy: Column, pw: Column, ph: Column) -> Column:
    """The box meets the visible box by more than the slack; a zero box (a generated character) always counts."""
    s = VISIBLE_SLACK
    return ((w == 0) & (h == 0)) | ((x + w > ox + s) & (x < ox + pw - s) & (y + h > oy + s) & (y < oy + ph - s))


def _turn(rotation: Column, r0: Column, r90: Column, r180: Column, r270: Column) -> Column:
    return F.when(rotation == 90, r90).when(rotation == 180, r180).when(rotation == 270, r270).otherwise(r0)


def pt_to_visual(x: Column, y: Column, ox: Column, oy: Column, w: Column, h: Column, rotation: Column) -> Column:
    """User space to the page as seen: struct<x,y>, origin top-left, Y down.  ``w``/``h`` are unrotated."""
    px, py = x - ox, y - oy
    return F.struct(
        _turn(rotation, px, py, w - px, h - py).alias("x"),
        _turn(rotation, h - py, px, py, w - px).alias("y"),
    )


def visual_to_pt(vx: Column, vy: Column, ox: Column, oy: Column, w: Column, h: Column, rotation: Column) -> Column:
    return F.struct(
        _turn(rotation, ox + vx, ox + vy, ox + w - vx, ox + w - vy).alias("x"),
        _turn(rotation, oy + h - vy, oy + vx, oy + vy, oy + h - vx).alias("y"),
    )


def rect_to_visual(x: Column, y: Column, rw: Column, rh: Column, ox: Column, oy: Column, w: Column, h: Column, rotation: Column) -> Column:
    a = pt_to_visual(x, y, ox, oy, w, h, rotation)
    b = pt_to_visual(x + rw, y + rh, ox, oy, w, h, rotation)
    return F.struct(
        F.least(a["x"], b["x"]).alias("left"),
        F.least(a["y"], b["y"]).alias("top"),
        F.abs(b["x"] - a["x"]).alias("width"),
        F.abs(b["y"] - a["y"]).alias("height"),
    )


def normalize_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("w"), F.abs(y1 - y0).alias("h"))


def bounded_scale(w: Column, h: Column, scale: Column) -> Column:
    """struct<scale,reduced>: the scale cut down until the bitmap keeps to the pixel and side limits."""
    s = F.when(finite(scale) & (scale > 0), scale).otherwise(F.lit(1.0))
    good = finite(w) & finite(h) & (w > 0) & (h > 0)
    px = w * s * h * s
    side = F.greatest(w, h) * s
    by_area = F.when(px > MAX_BITMAP_PIXELS, F.sqrt(F.lit(float(MAX_BITMAP_PIXELS)) / px) * BOUND_MARGIN).otherwise(F.lit(1.0))
    by_side = F.when(side > MAX_BITMAP_SIDE, F.lit(float(MAX_BITMAP_SIDE)) / side * BOUND_MARGIN).otherwise(F.lit(1.0))
    f = F.when(good, F.least(by_area, by_side)).otherwise(F.lit(1.0))
    return F.struct((s * f).alias("scale"), (f < 1).alias("reduced"))


def fit_width(available: Column, width: Column, low: float = 0.25, high: float = 4.0) -> Column:
    scale = F.floor(available / F.when(width > 0, width) * 1000) / 1000.0
    return F.when((available <= 0) | (width <= 0), F.lit(low)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), scale)))


def sharpness(dpr: Column, css_w: Column, css_h: Column) -> Column:
    d = F.when(finite(dpr) & (dpr > 0), dpr).otherwise(F.lit(1.0))
    f = F.least(d, F.lit(MAX_SHARPNESS))
    area = F.greatest(F.lit(1.0), css_w * css_h)
    return F.greatest(F.lit(1.0), F.when(area * f * f > MAX_BITMAP_PIXELS, F.sqrt(MAX_BITMAP_PIXELS / area)).otherwise(f))


def valid_page_size(w: Column, h: Column, user_unit: Column) -> Column:
    limit = MAX_PAGE_SIDE_PT * F.when(finite(user_unit) & (user_unit > 0), user_unit).otherwise(F.lit(1.0))
    return F.coalesce(finite(w) & finite(h) & (w > 0) & (h > 0) & (w <= limit) & (h <= limit), F.lit(False))


def point_in_quad(px: Column, py: Column, quad: Column) -> Column:
    """Point in the convex quad given as 8 numbers in any corner order; a quad without area holds nothing."""
    corners = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(quad[k * 2].alias("x"), quad[k * 2 + 1].alias("y")))
    cx = (quad[0] + quad[2] + quad[4] + quad[6]) / 4
    cy = (quad[1] + quad[3] + quad[5] + quad[7]) / 4
    ordered = F.array_sort(F.transform(corners, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    edges = F.zip_with(ordered, F.concat(F.slice(ordered, 2, 3), F.slice(ordered, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def judge(es: Column) -> Column:
        area2 = F.abs(F.aggregate(es, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
        eps = F.sqrt(area2) * 1e-6
        cross = F.transform(es, lambda e: (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (px - e["a"]["x"]))
        left = F.exists(cross, lambda c: c > eps)
        right = F.exists(cross, lambda c: c < -eps)
        return (area2 >= 1e-9) & ~(left & right)

    return F.element_at(F.transform(F.array(edges), judge), 1)


def rect_quad(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y + h, x + w, y + h, x, y, x + w, y)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(len2 != 0, len2))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def place_box(vis_w: Column, vis_h: Column, rotation: Column, ox: Column, oy: Column, zone: Column, align: Column, text_w: Column, size: Column, margin_x: Column, margin_y: Column) -> Column:
    """Baseline origin of a header or footer text, in user space: struct<x,y,angle>."""
    vx = F.when(align == "left", margin_x).when(align == "right", vis_w - margin_x - text_w).otherwise((vis_w - text_w) / 2)
    vy = F.when(zone == "top", vis_h - margin_y - ASCENT * size).otherwise(margin_y + DESCENT * size)
    return _visual_up(vis_w, vis_h, rotation, ox, oy, vx, vy, rotation.cast("double"))


def place_watermark(vis_w: Column, vis_h: Column, rotation: Column, ox: Column, oy: Column, text_w: Column, size: Column, angle: Column) -> Column:
    """Baseline origin of a text centred on the page and turned by ``angle`` degrees as seen."""
    t = F.radians(angle)
    lx, ly = -text_w / 2, -(size * ASCENT) / 2
    vx = vis_w / 2 + lx * F.cos(t) - ly * F.sin(t)
    vy = vis_h / 2 + lx * F.sin(t) + ly * F.cos(t)
    return _visual_up(vis_w, vis_h, rotation, ox, oy, vx, vy, angle + rotation)


def _visual_up(vis_w, vis_h, rotation, ox, oy, vx, vy, angle) -> Column:
    swap = rotation.isin(90, 270)
    w = F.when(swap, vis_h).otherwise(vis_w)
    h = F.when(swap, vis_w).otherwise(vis_h)
    p = visual_to_pt(vx, vis_h - vy, ox, oy, w, h, rotation)
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), angle.alias("angle"))


def fixed_text_width(text: Column, size: Column, em: float = 0.6) -> Column:
    return F.length(text) * em * size
