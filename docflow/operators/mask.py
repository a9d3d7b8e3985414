"""Crops of boxes with padding, and the rectangles to blank out in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_idx"]


def crops(df: DataFrame) -> DataFrame:
    """Adds px1, py1, px2, py2: each box padded by a fiftieth of its width and three hundredths of its height, six at
    least, within the page; and out_w, out_h, the crop's size after upscaling if it is under 64 high."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pad_x, pad_y = F.greatest(F.lit(6), (w * F.lit(0.02)).cast("int")), F.greatest(F.lit(6), (h * F.lit(0.03)).cast("int"))
    padded = df.withColumns(
        {
            "px1": F.greatest(F.lit(0), F.col("x1") - pad_x),
            "py1": F.greatest(F.lit(0), F.col("y1") - pad_y),
            "px2": F.least(F.col("page_w"), F.col("x2") + pad_x),
            "py2": F.least(F.col("page_h"), F.col("y2") + pad_y),
        }
    )
    cw, ch = F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1")
    small = ch < 64
    return padded.withColumns({"out_w": F.when(small, (cw * (F.lit(128.0) / ch)).cast("int")).otherwise(cw), "out_h": F.when(small, 128).otherwise(ch)})


def overlaps(df: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pairs of a box (its columns as they are, padded) and another box of its page (o_...) that meets its padded crop:
    an equi-join on the page with the range condition on top. ``others``: all boxes of the pages, if ``df`` is a part."""
    target = crops(df)
    other = (df if others is None else others).select(*PAGE, F.col("det_idx").alias("o_idx"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    meets = (F.col("o_x1") < F.col("px2")) & (F.col("o_x2") > F.col("px1")) & (F.col("o_y1") < F.col("py2")) & (F.col("o_y2") > F.col("py1"))
    met = target.join(other, PAGE).where((F.col("det_idx") != F.col("o_idx")) & meets)
    # what lies within the crop, in its own coordinates
    return met.withColumns(
        {
            "l_x1": F.greatest("px1", "o_x1") - F.col("px1"),
            "l_y1": F.greatest("py1", "o_y1") - F.col("py1"),
            "l_x2": F.least("px2", "o_x2") - F.col("px1"),
            "l_y2": F.least("py2", "o_y2") - F.col("py1"),
            "c_x1": F.col("x1") - F.col("px1"),
            "c_y1": F.col("y1") - F.col("py1"),
            "c_x2": F.col("x2") - F.col("px1"),
            "c_y2": F.col("y2") - F.col("py1"),
        }
    )


def _clipped(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """The overlap cut to a rectangle of the crop."""
    return [F.greatest("l_x1", x1).alias("x1"), F.greatest("l_y1", y1).alias("y1"), F.least("l_x2", x2).alias("x2"), F.least("l_y2", y2).alias("y2")]


def core_masks(pairs: DataFrame) -> DataFrame:
    """Rectangles of boxes of less than half the target's area, within the target itself."""
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    small = pairs.where(area("o_") < area("") * F.lit(0.5))
    rects = small.select(*PAGE, "det_idx", "o_idx", *_clipped(F.col("c_x1"), F.col("c_y1"), F.col("c_x2"), F.col("c_y2")))
    return rects.where("x2 > x1 AND y2 > y1")


def ring_masks(pairs: DataFrame) -> DataFrame:
    """Rectangles of other boxes within the padding: side is left, right, top or bottom of the target."""
    pw, ph, zero = F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1"), F.lit(0)
    sides = {"left": (zero, zero, F.col("c_x1"), ph), "right": (F.col("c_x2"), zero, pw, ph), "top": (zero, zero, pw, F.col("c_y1")), "bottom": (zero, F.col("c_y2"), pw, ph)}
    each = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), *_clipped(*r)) for side, r in sides.items())))
    return pairs.select(*PAGE, "det_idx", "o_idx", each.alias("r")).select(*PAGE, "det_idx", "o_idx", "r.*").where("x2 > x1 AND y2 > y1")
