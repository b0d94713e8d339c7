"""Boxes as Columns. A box is four Columns x0, y0, x1, y1, unit-agnostic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: pixels a PDF point at 300 dots an inch.
PX_PER_PT = 300 / 72


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    def scaled(self, sx, sy) -> "Box":
        return Box(self.x0 / sx, self.y0 / sy, self.x1 / sx, self.y1 / sy)

    def sorted(self) -> "Box":
        return Box(F.least(self.x0, self.x1), F.least(self.y0, self.y1), F.greatest(self.x0, self.x1), F.greatest(self.y0, self.y1))

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(self._fields, self)))


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), a.width) * F.greatest(F.lit(0.0), a.height)


def shared(a: Box, b: Box) -> tuple[Column, Column]:
    """Extent of the common part along x and y, negative where the boxes are apart."""
    return F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)


def intersection_area(a: Box, b: Box) -> Column:
    w, h = shared(a, b)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def covered_share(a: Box, b: Box) -> Column:
    """Part of a inside b; 0 for an empty a."""
    return F.when(area(a) > 0, intersection_area(a, b) / area(a)).otherwise(F.lit(0.0))


def smallest_share(a: Box, b: Box) -> Column:
    """Common area as a part of the smaller box; 0 when either is empty."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection_area(a, b) / least).otherwise(F.lit(0.0))


def pair_metrics(p: Box, t: Box, horizontal: Column) -> dict[str, Column]:
    """Six metrics of an overlapping prediction p and truth t; horizontal says how the truth box lies in points."""
    o = intersection_area(p, t)
    w, h = shared(p, t)
    short, on_short = F.when(horizontal, t.height).otherwise(t.width), F.greatest(F.lit(0.0), F.when(horizontal, h).otherwise(w))
    long, on_long = F.when(horizontal, t.width).otherwise(t.height), F.greatest(F.lit(0.0), F.when(horizontal, w).otherwise(h))
    off = F.when(horizontal, F.abs((p.y0 + p.y1) / 2 - (t.y0 + t.y1) / 2)).otherwise(F.abs((p.x0 + p.x1) / 2 - (t.x0 + t.x1) / 2))
    return {
        "cov_area": o / area(t),
        "cov_pred": F.when(area(p) > 0, o / area(p)).otherwise(F.lit(0.0)),
        "iou": o / (area(t) + area(p) - o),
        "cov_short": F.when(short > 0, on_short / short).otherwise(F.lit(0.0)),
        "cov_long": F.when(long > 0, on_long / long).otherwise(F.lit(0.0)),
        "center_short": F.when(short > 0, off / short).otherwise(F.lit(9.9)),
    }


#: Criterion -> (metric, whether a low value is good).
CRITERIA = {"area": ("cov_area", False), "short_side": ("cov_short", False), "long_side": ("cov_long", False), "iou": ("iou", False), "center": ("center_short", True)}


def passes(criterion: str, threshold: float, metric=F.col) -> Column:
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}; one of {', '.join(sorted(CRITERIA))}")
    name, low = CRITERIA[criterion]
    return metric(name) <= threshold if low else metric(name) >= threshold


def centre_inside(a: Box, b: Box) -> Column:
    """Whether the centre of a lies in b, edges included."""
    cx, cy = (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2
    return cx.between(b.x0, b.x1) & cy.between(b.y0, b.y1)


def same_box(a: Box, b: Box) -> Column:
    return centre_inside(a, b) | centre_inside(b, a)


def turned(a: Box, width: Column, height: Column, quarters: Column) -> Box:
    """The box after `quarters` clockwise quarter turns of a width x height page."""
    q = F.pmod(quarters, F.lit(4))

    def pick(c0, c1, c2, c3):
        return F.when(q == 0, c0).when(q == 1, c1).when(q == 2, c2).otherwise(c3)

    return Box(
        pick(a.x0, height - a.y1, width - a.x1, a.y0),
        pick(a.y0, a.x0, height - a.y1, width - a.x1),
        pick(a.x1, height - a.y0, width - a.x0, a.y1),
        pick(a.y1, a.x1, height - a.y0, width - a.x0),
    )


def unturned(a: Box, width: Column, height: Column, quarters: Column) -> Box:
    """Undo `turned`; width and height are those of the page before turning."""
    q = F.pmod(quarters, F.lit(4))
    odd = q % 2 == 1
    return turned(a, F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height), F.lit(4) - q)


def to_points(a: Box) -> Box:
    return Box(*(c / PX_PER_PT for c in a)).sorted()


def to_pixels(a: Box) -> Box:
    return Box(*(c * PX_PER_PT for c in a))


def placement(a: Box, width: Column, height: Column, tolerance: float = 1.0) -> Column:
    """inside, partial or outside a page; the tolerance counts for inside only, which is tested first."""
    inside = (a.x0 >= -tolerance) & (a.y0 >= -tolerance) & (a.x1 <= width + tolerance) & (a.y1 <= height + tolerance)
    outside = (a.x1 <= 0) | (a.y1 <= 0) | (a.x0 >= width) | (a.y0 >= height)
    return F.when(inside, "inside").when(outside, "outside").otherwise("partial")


def same_line(a: Box, b: Box, slack: float = 4.0) -> Column:
    return (a.y0 - slack <= b.y1) & (b.y0 - slack <= a.y1)


def equal_within(a: Box, b: Box, tolerance: float) -> Column:
    out = F.lit(True)
    for u, v in zip(a, b):
        out = out & (F.abs(u - v) <= tolerance)
    return out


def boxes_differ(a: Box, b: Box, more_than: float = 1.0) -> Column:
    """Whether any of the four numbers differs by more than the given points."""
    return ~equal_within(a, b, more_than)


def centre_format(a: Box, page_width: Column, page_height: Column) -> Column:
    """'0 cx cy w h' relative to the page, clipped to 0..1, six decimals."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    x0, y0, x1, y1 = clip(a.x0 / page_width), clip(a.y0 / page_height), clip(a.x1 / page_width), clip(a.y1 / page_height)
    return F.format_string("0 %.6f %.6f %.6f %.6f", (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0)


#: Least stroke of a marker, crop width for each further pixel of it, and what the marker is wider than its stroke.
STROKE, STROKE_PER, STROKE_PAD = 3, 400, 2


def crop_with_marker(a: Box, width: Column, height: Column, left: float, top: float, right: float, bottom: float, widest: int | None = None) -> Column:
    """struct(reason, crop, marker, factor): the crop around a box by four margins (in pixels; negative: to the page's edge), in whole pixels.

    A crop wider than `widest` is shrunk to it, and the marker, the box with a pad that grows with the crop's width, is
    placed in the shrunk crop. reason is outside where the box misses the page, empty where nothing is left, marker where
    the marker has no area, else null; without a crop the other fields are null.
    """
    whole = lambda c: c.cast("int").cast("double")
    reach = lambda margin, near, edge: edge.cast("double") if margin < 0 else near
    x0 = reach(left, F.greatest(F.lit(0.0), whole(a.x0 - left)), F.lit(0.0))
    y0 = reach(top, F.greatest(F.lit(0.0), whole(a.y0 - top)), F.lit(0.0))
    x1 = reach(right, F.least(width, whole(a.x1 + right)), width)
    y1 = reach(bottom, F.least(height, whole(a.y1 + bottom)), height)
    shrinks = F.lit(False) if widest is None else (x1 - x0) > widest
    factor = F.when(shrinks, F.lit(float(widest or 0)) / (x1 - x0)).otherwise(F.lit(1.0))
    w = F.when(shrinks, F.lit(float(widest or 0))).otherwise(x1 - x0)
    h = F.when(shrinks, F.greatest(F.lit(1.0), whole((y1 - y0) * factor))).otherwise(y1 - y0)
    pad = F.greatest(F.lit(STROKE), F.bround(w / STROKE_PER)) + STROKE_PAD
    marker = Box(
        F.greatest(F.lit(0.0), (a.x0 - x0) * factor - pad), F.greatest(F.lit(0.0), (a.y0 - y0) * factor - pad),
        F.least(w - 1, (a.x1 - x0) * factor + pad), F.least(h - 1, (a.y1 - y0) * factor + pad),
    )
    outside = (a.x1 <= 0) | (a.y1 <= 0) | (a.x0 >= width) | (a.y0 >= height)
    reason = F.when(outside, "outside").when((x1 <= x0) | (y1 <= y0), "empty").when((marker.x1 <= marker.x0) | (marker.y1 <= marker.y0), "marker")
    drawn = lambda c: F.when(reason.isNull(), c)
    return F.struct(reason.alias("reason"), drawn(Box(x0, y0, x1, y1).struct()).alias("crop"), drawn(marker.struct()).alias("marker"), drawn(factor).alias("factor"))
