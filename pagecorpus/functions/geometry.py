"""Rectangle arithmetic on block tables.

Rectangles are structs ``(x, y, width, height)`` of doubles. Normalised boxes are
fractions of the image with a top-left origin; pixel rectangles have their origin at
the bottom left, so ``y`` grows upwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The factors, shares and pixel limits in the functions below.

VERTICAL = "vertical"
HORIZONTAL = "horizontal"


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def max_x(r: Column) -> Column:
    return r["x"] + r["width"]


def max_y(r: Column) -> Column:
    return r["y"] + r["height"]


def clipped_corners(xyxy: Column, img_w: Column, img_h: Column) -> Column:
    """Corner struct cut to the image, null unless four numbers span a positive area."""
    x1, y1, x2, y2 = (F.get(xyxy, F.lit(i)) for i in range(4))
    complete = (F.size(xyxy) == 4) & x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    corners = F.struct(
        F.greatest(F.lit(0.0), x1).alias("x1"),
        F.greatest(F.lit(0.0), y1).alias("y1"),
        F.least(img_w, x2).alias("x2"),
        F.least(img_h, y2).alias("y2"),
    )
    spans = (F.least(img_w, x2) > F.greatest(F.lit(0.0), x1)) & (F.least(img_h, y2) > F.greatest(F.lit(0.0), y1))
    return F.when(complete & spans, corners)


def box_of_corners(c: Column, img_w: Column, img_h: Column) -> Column:
    """Fractional top-left box of pixel corners ``(x1, y1, x2, y2)``."""
    return rect(c["x1"] / img_w, c["y1"] / img_h, (c["x2"] - c["x1"]) / img_w, (c["y2"] - c["y1"]) / img_h)


def normalised_box(xyxy: Column, img_w: Column, img_h: Column) -> Column:
    """Fractional box of a corner list; null when the corners are not usable."""
    c = clipped_corners(xyxy, img_w, img_h)
    return F.when(c.isNotNull(), box_of_corners(c, img_w, img_h))


def flip_box(box: Column) -> Column:
    """Bottom-left fractional box to top-left."""
    return rect(box["x"], F.lit(1.0) - (box["y"] + box["height"]), box["width"], box["height"])


def pixel_rect(box: Column, img_w: Column, img_h: Column) -> Column:
    width = F.greatest(F.lit(1.0), box["width"] * img_w)
    height = F.greatest(F.lit(1.0), box["height"] * img_h)
    return rect(box["x"] * img_w, img_h - box["y"] * img_h - height, width, height)


def inset(r: Column, dx: Column, dy: Column) -> Column:
    """Move all four sides inwards (outwards for negative amounts).

    Where nothing would remain in a direction the rectangle is empty: size 0 by 0.
    """
    width, height = r["width"] - F.lit(2.0) * dx, r["height"] - F.lit(2.0) * dy
    empty = (width < 0) | (height < 0)
    return rect(
        r["x"] + dx,
        r["y"] + dy,
        F.when(empty, 0.0).otherwise(width),
        F.when(empty, 0.0).otherwise(height),
    )


def clamp_rect(r: Column, img_w: Column, img_h: Column) -> Column:
    """Cut to the image; at least one pixel remains in both directions."""
    x, y = F.greatest(F.lit(0.0), r["x"]), F.greatest(F.lit(0.0), r["y"])
    width = F.greatest(F.lit(1.0), F.least(img_w, max_x(r)) - x)
    height = F.greatest(F.lit(1.0), F.least(img_h, max_y(r)) - y)
    return rect(x, y, width, height)


def union_rect(a: Column, b: Column) -> Column:
    """Smallest rectangle around both."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(max_x(a), max_x(b)) - x, F.greatest(max_y(a), max_y(b)) - y)


def integral_rect(r: Column) -> Column:
    """Grow to whole pixels: floor of the low sides, ceiling of the high sides."""
    x, y = F.floor(r["x"]).cast("double"), F.floor(r["y"]).cast("double")
    return rect(x, y, F.ceil(max_x(r)).cast("double") - x, F.ceil(max_y(r)).cast("double") - y)


def text_flow(r: Column, n_chars: Column) -> Column:
    """Vertical for at most eight characters in a box at least 2.05 times as tall as wide."""
    tall = r["height"] >= r["width"] * F.lit(2.05)
    return F.when(tall & (n_chars <= 8), VERTICAL).otherwise(HORIZONTAL)


def redaction_rect(r: Column, flow: Column, n_chars: Column, img_w: Column, img_h: Column) -> Column:
    """Area to cover behind the text: padding grows with the character count."""
    n = n_chars.cast("double")
    share_x_v = F.least(F.lit(0.24), F.lit(0.12) + n * F.lit(0.004))
    share_x_h = F.least(F.lit(0.26), F.lit(0.10) + n * F.lit(0.004))
    share_y_h = F.least(F.lit(0.18), F.lit(0.08) + n * F.lit(0.002))
    vertical = flow == VERTICAL
    dx = F.greatest(F.lit(10.0), r["width"] * F.when(vertical, share_x_v).otherwise(share_x_h))
    dy = F.when(vertical, F.greatest(F.lit(8.0), r["height"] * F.lit(0.08))).otherwise(
        F.greatest(F.lit(7.0), r["height"] * share_y_h)
    )
    return clamp_rect(inset(r, -dx, -dy), img_w, img_h)


def text_inset(r: Column, flow: Column) -> Column:
    """Usable text area inside a container."""
    vertical = flow == VERTICAL
    dx = F.when(vertical, F.greatest(F.lit(4.0), r["width"] * F.lit(0.10))).otherwise(
        F.greatest(F.lit(6.0), r["width"] * F.lit(0.05))
    )
    dy = F.when(vertical, F.greatest(F.lit(6.0), r["height"] * F.lit(0.05))).otherwise(
        F.greatest(F.lit(5.0), r["height"] * F.lit(0.07))
    )
    return inset(r, dx, dy)


def light_search_rect(r: Column, flow: Column, img_w: Column, img_h: Column) -> Column:
    """Padded window around a text rectangle in which its light region is looked for."""
    vertical = flow == VERTICAL
    dx = F.when(vertical, F.greatest(F.lit(54.0), r["width"] * F.lit(1.25))).otherwise(
        F.greatest(F.lit(72.0), r["width"] * F.lit(0.65))
    )
    dy = F.when(vertical, F.greatest(F.lit(48.0), r["height"] * F.lit(0.30))).otherwise(
        F.greatest(F.lit(60.0), r["height"] * F.lit(0.28))
    )
    return clamp_rect(inset(r, -dx, -dy), img_w, img_h)


def _grid_step(img_w: Column, img_h: Column, divisor: int, low: int, high: int) -> Column:
    step = F.floor(F.least(img_w, img_h) / F.lit(float(divisor))).cast("double")
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), step))


def region_step(img_w: Column, img_h: Column) -> Column:
    """Sampling distance of the light-region search, 6 to 14 pixels by image size."""
    return _grid_step(img_w, img_h, 550, 6, 14)


def coverage_step(img_w: Column, img_h: Column) -> Column:
    """Sampling distance of light coverage, 8 to 16 pixels by image size."""
    return _grid_step(img_w, img_h, 480, 8, 16)


def grid_extent(r: Column, step: Column) -> tuple[Column, Column]:
    """Rows and columns of a sampling grid over ``r``."""
    rows = F.greatest(F.lit(1), F.ceil(r["height"] / step).cast("int"))
    cols = F.greatest(F.lit(1), F.ceil(r["width"] / step).cast("int"))
    return rows, cols


def sample_x(r: Column, step: Column, col: Column) -> Column:
    return r["x"] + (col.cast("double") + F.lit(0.5)) * step


def sample_y(r: Column, step: Column, row: Column) -> Column:
    return r["y"] + (row.cast("double") + F.lit(0.5)) * step


def contains_point(r: Column, x: Column, y: Column) -> Column:
    """Low sides count as inside, high sides do not."""
    return (x >= r["x"]) & (x < max_x(r)) & (y >= r["y"]) & (y < max_y(r))


def pixel_index(position: Column, extent: Column, pixels: Column) -> Column:
    """Pixel column (or row) of a position in an image of ``pixels`` columns, clamped."""
    raw = ((position / extent) * pixels.cast("double")).cast("int")
    return F.greatest(F.lit(0), F.least(pixels.cast("int") - F.lit(1), raw))


def is_light(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Bright, barely coloured and not transparent; channels run from 0 to 1."""
    luminance = F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return (a > 0.2) & (luminance >= 0.82) & (spread <= 0.18)
