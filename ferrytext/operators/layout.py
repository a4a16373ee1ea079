"""Typesetting arithmetic on columns: sizes, columns, wrapping and anchors. Nothing is drawn."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MIN_FONT, MAX_FONT = 12, 72


def estimate_font_size(width: Column, height: Column, length: Column, orientation: Column) -> Column:
    w, h = F.greatest(F.lit(4), width), F.greatest(F.lit(4), height)
    square = F.greatest(F.lit(6.0), F.sqrt(w * h / F.greatest(F.lit(1), length)))
    return F.least(F.when(orientation == "vertical", w).otherwise(h).cast("double"), square).cast("int")


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]", "")


def vertical_layout(length: Column, size: Column, height: Column) -> Column:
    """(n_columns, used_width, used_height, cell, rows) of ``length`` characters set in columns."""
    cell = F.greatest(F.lit(1), (size * 1.08).cast("int"))
    rows = F.greatest(F.lit(1), F.floor(height / cell).cast("int"))
    n = F.ceil(length / rows).cast("int")
    return F.struct(n.alias("n_columns"), (n * cell).alias("used_width"), (F.least(rows, length) * cell).alias("used_height"), cell.alias("cell"), rows.alias("rows"))


def vertical_columns(text: Column, rows: Column) -> Column:
    """The characters of each column."""
    text = plain(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), rows)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, rows)))


def fit_vertical_font(length: Column, width: Column, height: Column, cap: Column, minimum: int = MIN_FONT) -> Column:
    """The largest size from minimum to cap whose columns fit, else the minimum."""
    w, h = F.greatest(F.lit(4), width), F.greatest(F.lit(4), height)
    sizes = F.sequence(F.lit(minimum), F.greatest(F.lit(minimum), cap))

    def fits(size: Column) -> Column:
        x = vertical_layout(length, size, h)
        return (x["used_width"] <= w) & (x["used_height"] <= h)

    return F.coalesce(F.array_max(F.filter(sizes, fits)), F.lit(minimum))


def advance(char: Column) -> Column:
    """Width of a character in thousandths of the size: wide scripts 1000, others 500."""
    return F.when(char.rlike(r"[\x{2e80}-\x{9fff}\x{ff00}-\x{ff60}]"), F.lit(1000)).otherwise(F.lit(500))


@F.arrow_udf(ArrayType(StringType()))
def _wrapped(texts: pa.Array, sizes: pa.Array, widths: pa.Array) -> pa.Array:
    out = []
    for text, size, width in zip(texts.to_pylist(), sizes.to_pylist(), widths.to_pylist()):
        if text is None or len(text) <= 3:
            out.append(None if text is None else [text])
            continue
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        wide = (points >= 0x2E80) & (points <= 0x9FFF) | (points >= 0xFF00) & (points <= 0xFF60)
        reach, lines, at = np.cumsum(np.where(wide, 1000, 500)), [], 0
        while at < len(text):
            used = reach[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(reach, used + width * 1000 // size, "right")))
            lines.append(text[at:end])
            at = end
        out.append(lines)
    return pa.array(out, pa.list_(pa.string()))


def horizontal_wrap(text: Column, size: Column, width: Column) -> Column:
    """Lines of characters filled greedily up to ``width``; three characters or fewer stay together."""
    return _wrapped(plain(text), size, width)


def line_height(size: Column, glyph_height: Column) -> Column:
    return F.greatest((size * 1.25).cast("int"), glyph_height + 2)


def color_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of (r, g, b) structs."""
    part = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return F.sqrt((part("r") + part("g") + part("b")).cast("double"))


def guarded_color(text: Column, background: Column) -> Column:
    """Text too near its background turns dark or light by the background's mean."""
    grey = lambda v: F.struct(*(F.lit(v).alias(k) for k in "rgb"))
    mean = (background["r"] + background["g"] + background["b"]) / 3
    return F.when(color_distance(text, background) < 45, F.when(mean > 128, grey(25)).otherwise(grey(245))).otherwise(text)


def typeset_plan(x0: Column, y0: Column, x1: Column, y1: Column, cx: Column, cy: Column, length: Column, cap: int, contrast: Column) -> Column:
    """Where and how large a vertical text is set: bounds inset by 3 %, grown by 5 % a side if even the smallest size
    overflows, anchors of the centre (cx, cy) from 0 to 1, and a stroke where contrast is low."""
    inset = F.greatest(F.lit(1), (F.least(x1 - x0, y1 - y0) * 0.03).cast("int"))
    ax0, ay0, ax1, ay1 = x0 + inset, y0 + inset, x1 - inset, y1 - inset
    w, h = F.greatest(F.lit(4), ax1 - ax0), F.greatest(F.lit(4), ay1 - ay0)
    estimate = estimate_font_size(ax1 - ax0, ay1 - ay0, length, F.lit("vertical"))
    top = F.least(F.lit(cap), F.greatest(F.lit(MIN_FONT), (estimate * 1.2).cast("int")))
    size = fit_vertical_font(length, w, h, top)
    used = vertical_layout(length, size, h)
    over = (used["used_width"] > w) | (used["used_height"] > h)
    gx, gy = F.greatest(F.lit(1), (w * 0.05).cast("int")), F.greatest(F.lit(1), (h * 0.05).cast("int"))
    bx0, by0 = F.when(over, F.greatest(F.lit(0), ax0 - gx)).otherwise(ax0), F.when(over, F.greatest(F.lit(0), ay0 - gy)).otherwise(ay0)
    bx1, by1 = F.when(over, ax1 + gx).otherwise(ax1), F.when(over, ay1 + gy).otherwise(ay1)
    bw, bh = F.greatest(F.lit(4), bx1 - bx0), F.greatest(F.lit(4), by1 - by0)
    anchor = lambda v, low, side: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / side))
    stroke = F.when(contrast < 60, F.greatest(F.lit(1), F.floor(size / 16).cast("int"))).otherwise(F.lit(0))
    return F.struct(
        bx0.alias("bx0"), by0.alias("by0"), bx1.alias("bx1"), by1.alias("by1"), size.alias("size"),
        anchor(cx, bx0, bw).alias("anchor_x"), anchor(cy, by0, bh).alias("anchor_y"), stroke.alias("stroke"),
    )
