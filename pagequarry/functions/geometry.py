"""Box rules as column expressions over struct<x0,y0,x1,y1>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as X


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x1"] - b["x0"]) * F.greatest(F.lit(0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return wide * F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for an empty union."""
    both = intersection(a, b)
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def inside(small: Column, large: Column, share: float) -> Column:
    return intersection(small, large) >= area(small) * share


def overlaps(a: Column, b: Column, gap: float = 2.0) -> Column:
    """Whether boxes overlap or lie within gap of each other."""
    return (a["x0"] < b["x1"] + gap) & (b["x0"] < a["x1"] + gap) & (a["y0"] < b["y1"] + gap) & (b["y0"] < a["y1"] + gap)


def scaled(b: Column, factor: Column, width: Column, height: Column) -> Column:
    """Points to whole pixels, cut off towards zero and clamped to the image."""
    px = lambda c, most: F.greatest(F.lit(0), F.least(most, (c * factor).cast("int")))
    return F.struct(px(b["x0"], width).alias("x0"), px(b["y0"], height).alias("y0"), px(b["x1"], width).alias("x1"), px(b["y1"], height).alias("y1"))


def unletterboxed(cx: Column, cy: Column, w: Column, h: Column, scale: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A detector's centre box on the padded square back on the page."""
    edge = lambda c, half, d, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), (c + half - d) / scale))
    return F.struct(edge(cx, -w / 2, dx, width).alias("x0"), edge(cy, -h / 2, dy, height).alias("y0"), edge(cx, w / 2, dx, width).alias("x1"), edge(cy, h / 2, dy, height).alias("y1"))


def detected(conf: Column, b: Column) -> Column:
    return (conf > X.DETECTOR_CONFIDENCE) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def lettering_on(r: Column, g: Column, b: Column) -> Column:
    return F.when(luminance(r, g, b) > 127, "black").otherwise("white")


def orientation(b: Column, gap_x: Column, gap_y: Column, page_vote: Column) -> Column:
    """vertical or horizontal: by extent, else by the gaps between strokes, else as the page, else by shape."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return (
        F.when(h >= w * 1.5, "vertical").when(w >= h * 1.5, "horizontal")
        .when((F.greatest(gap_x, gap_y) >= 3) & (gap_x >= gap_y * 1.5), "vertical")
        .when((F.greatest(gap_x, gap_y) >= 3) & (gap_y >= gap_x * 1.5), "horizontal")
        .when(page_vote.isNotNull(), page_vote).otherwise(F.when(h > w, "vertical").otherwise("horizontal"))
    )


def clean_font_size(value: Column) -> Column:
    """Points chosen by hand: 0 for none or nonsense, else within bounds, to one decimal."""
    v = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v > 0)
    low, high = X.FONT_POINTS
    return F.when(good, F.bround(F.least(F.greatest(v, F.lit(low)), F.lit(high)), 1)).otherwise(F.lit(0.0))


def character_shape(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Whether a region may be a character: neither a line nor a blob."""
    aspect = w / (h + 1e-5)
    return (aspect > 0.15) & (aspect < 8.0) & (w < page_w * 0.2) & (h < page_h * 0.2)


def line_shape(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    return (w > 15) & (h > 8) & (w < page_w * 0.95) & (h < page_h * 0.95)


def window(b: Column, width: Column, height: Column, size: int = 512) -> Column:
    """A box grown to a window of size around its centre, moved inside the image; larger sides stay."""

    def side(low: Column, high: Column, limit: Column) -> tuple[Column, Column]:
        room = F.least(F.lit(size), limit)
        start = F.greatest(F.lit(0), F.least(F.floor((low + high) / 2) - F.floor(room / 2), limit - room))
        fits = high - low >= room
        return F.when(fits, low).otherwise(start), F.when(fits, high).otherwise(start + room)

    (x0, x1), (y0, y1) = side(b["x0"], b["x1"], width), side(b["y0"], b["y1"], height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
