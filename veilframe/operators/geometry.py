"""Rectangles and text runs on a page, as column expressions.

A rectangle is struct<x, y, w, h> with x, y at its lower left corner. A run of text starts at
(x, y), goes along the unit vector (dx, dy) for w points and is h points high; its characters
share its width evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A rectangle of four numbers; null if one of them is."""
    made = F.struct(*[v.cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), made)


def share_of_run(a: Column, b: Column) -> Column:
    """The upright rectangle around the part of a run (columns x, y, dx, dy, w, h) between the
    shares a and b of its width, whatever its direction."""
    x, y, dx, dy, w, h = (F.col(c) for c in ("x", "y", "dx", "dy", "w", "h"))
    left, low = x + dx * w * a, y + dy * w * a
    along_x, along_y, up_x, up_y = dx * w * (b - a), dy * w * (b - a), -dy * h, dx * h
    zero = F.lit(0.0)
    least = [F.least(zero, p) + F.least(zero, q) for p, q in ((along_x, up_x), (along_y, up_y))]
    most = [F.abs(p) + F.abs(q) for p, q in ((along_x, up_x), (along_y, up_y))]
    return box(left + least[0], low + least[1], most[0], most[1])


def common(a: Column, b: Column) -> tuple[Column, Column]:
    """Width and height of what two rectangles share; not positive where they are apart."""
    return tuple(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]) for p, s in (("x", "w"), ("y", "h")))


def meets(a: Column, b: Column) -> Column:
    """True if two rectangles share more than an edge."""
    wide, high = common(a, b)
    return (wide > 0) & (high > 0)


def overlap_share(a: Column, b: Column) -> Column:
    """The share of a's area that lies in b."""
    wide, high = (F.greatest(v, F.lit(0.0)) for v in common(a, b))
    return wide * high / F.greatest(F.lit(1e-6), a["w"] * a["h"])


def covered(text: Column, mask: Column, tolerance: float = 1.5) -> Column:
    """True if mask covers more of the rectangle text than a margin of tolerance points, which
    is never over half its width or three tenths of its height."""
    wide, high = common(text, mask)
    enough = (wide > F.least(F.lit(tolerance), text["w"] / 2)) & (high > F.least(F.lit(tolerance), text["h"] * 0.3))
    return (wide > 0) & (high > 0) & enough


def joined_boxes(boxes: Column) -> Column:
    """Rectangles (an array) with those side by side on a line made one: tops differ by less
    than half the lower height, and the gap is at most 0.6 of the higher one. From top to
    bottom, then from left to right; null and empty arrays give an empty one."""
    flat = F.transform(boxes, lambda b: F.struct((-b["y"]).alias("down"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h")))
    ordered = F.transform(F.sort_array(flat), lambda b: box(b["x"], -b["down"], b["w"], b["h"]))

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = (F.abs(last["y"] - b["y"]) < 0.5 * F.least(last["h"], b["h"])) & (b["x"] <= last["x"] + last["w"] + 0.6 * F.greatest(last["h"], b["h"]))
        x, y = F.least(last["x"], b["x"]), F.least(last["y"], b["y"])
        right, top = F.greatest(last["x"] + last["w"], b["x"] + b["w"]), F.greatest(last["y"] + last["h"], b["y"] + b["h"])
        one = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(box(x, y, right - x, top - y)))
        return F.when(last.isNotNull() & near, one).otherwise(F.concat(done, F.array(b)))

    empty = F.array().cast(f"array<{BOX}>")
    return F.aggregate(F.coalesce(ordered, empty), empty, step)


def to_view(b: Column, page_width: Column, page_height: Column, scale: float = 1.0, rotation: int = 0) -> Column:
    """A page rectangle as struct<left, top, width, height> in pixels from the upper left corner
    of the page turned clockwise by 0, 90, 180 or 270 degrees."""
    left = {0: b["x"], 90: b["y"], 180: page_width - b["x"] - b["w"], 270: page_height - b["y"] - b["h"]}[rotation]
    top = {0: page_height - b["y"] - b["h"], 90: b["x"], 180: b["y"], 270: page_width - b["x"] - b["w"]}[rotation]
    size = (b["w"], b["h"]) if rotation % 180 == 0 else (b["h"], b["w"])
    return F.struct(*[(v * scale).alias(n) for v, n in ((left, "left"), (top, "top"), (size[0], "width"), (size[1], "height"))])


def to_page(v: Column, page_width: Column, page_height: Column, scale: float = 1.0, rotation: int = 0) -> Column:
    """The page rectangle of a rectangle of to_view."""
    left, top, width, height = (v[n] / scale for n in ("left", "top", "width", "height"))
    x = {0: left, 90: top, 180: page_width - left - width, 270: page_width - top - height}[rotation]
    y = {0: page_height - top - height, 90: left, 180: top, 270: page_height - left - width}[rotation]
    return box(x, y, width, height) if rotation % 180 == 0 else box(x, y, height, width)


def percent_place(b: Column, page_width: Column, page_height: Column) -> Column:
    """Where a rectangle is, like 12% / 40%: from the left and from above."""
    across = F.floor(b["x"] / page_width * 100 + 0.5).cast("string")
    down = F.floor((page_height - b["y"] - b["h"]) / page_height * 100 + 0.5).cast("string")
    return F.coalesce(F.concat(across, F.lit("% / "), down, F.lit("%")), F.lit(""))


def card_shaped(regions: DataFrame) -> DataFrame:
    """Regions of a scan (ratio: width by height, width: share of the page's, fill) that look
    like an identity card, upright or lying."""
    ratio = F.col("ratio")
    fits = ratio.between(1.4, 1.8) | (1 / ratio).between(1.4, 1.8)
    return regions.where(fits & F.col("width").between(0.25, 0.7) & (F.col("fill") >= 0.6))
