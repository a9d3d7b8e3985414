"""Overlays of boxes on page pictures: outlines in painter's order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators import pixels

PAGE = ["doc_id", "page_idx"]
IMAGE = "doc_id string, page_idx int, image binary"
#: Colours by name (fixed values).
RGB = {"green": (0, 128, 0), "blue": (0, 0, 255), "red": (255, 0, 0), "purple": (128, 0, 128), "yellow": (255, 255, 0), "orange": (255, 165, 0)}
WIDTH = 3


def outlined(image: np.ndarray, rects: list[tuple[int, int, int, int]], colors: list[str], width: int = WIDTH) -> np.ndarray:
    """With outlines that lie within their rectangles, both corners included; later ones cover earlier ones. What lies
    beyond the page isn't drawn, rectangles that run backwards are not."""
    out = image.copy()
    for (x1, y1, x2, y2), color in zip(rects, colors, strict=True):
        if x2 < x1 or y2 < y1:
            continue
        runs = ((x1, y1, x2, min(y1 + width - 1, y2)), (x1, max(y2 - width + 1, y1), x2, y2), (x1, y1, min(x1 + width - 1, x2), y2), (max(x2 - width + 1, x1), y1, x2, y2))
        for a, b, c, d in runs:
            out[max(b, 0) : max(d + 1, 0), max(a, 0) : max(c + 1, 0)] = RGB[color]
    return out


def _painted(page: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    if page.empty:
        return pd.DataFrame(columns=["doc_id", "page_idx", "image"])
    p = page.iloc[0]
    boxes = boxes.sort_values("nth", kind="stable")
    rects = list(zip(boxes["x1"], boxes["y1"], boxes["x2"], boxes["y2"], strict=True))
    image = outlined(pixels.from_source(p["data"], p["width"], p["height"], p["nChannels"]), rects, list(boxes["color"]))
    return pd.DataFrame([(p["doc_id"], p["page_idx"], pixels.to_png(image))], columns=["doc_id", "page_idx", "image"])


def overlay_images(pages: DataFrame, draw: DataFrame, order: str) -> DataFrame:
    """Rows of IMAGE, one for each page with a decoded picture, with the outlines of a draw list (x1, y1, x2, y2, color)
    in the order of a column. Pages without boxes stay as they are."""
    left = pages.select(*(F.col(c).alias(c) for c in PAGE), "width", "height", "nChannels", "data").groupBy(*PAGE)
    right = draw.select(*PAGE, F.col(order).alias("nth"), "x1", "y1", "x2", "y2", "color").groupBy(*PAGE)
    return left.cogroup(right).applyInPandas(_painted, IMAGE)


def listed(draw: DataFrame, order: str) -> DataFrame:
    """doc_id, page_idx, outlines: a page's draw list in the order of a column, to be joined to pages before their pictures
    are read; then no pictures are sent to it."""
    one = F.struct(F.col(order).alias("nth"), "x1", "y1", "x2", "y2", "color")
    rows = draw.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("o"))
    return rows.select(*PAGE, F.struct(*(F.col(f"o.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "color"))).alias("outlines"))


def overlays_of(pages: DataFrame) -> DataFrame:
    """``overlay_images`` for pages that have their ``outlines`` (of ``listed``; null: none) beside their pictures."""
    flat = pages.select(*PAGE, "width", "height", "nChannels", "data", *(F.col(f"outlines.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "color")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for p in pdf.itertuples(index=False):
                rects = [] if p.x1 is None else list(zip(p.x1.tolist(), p.y1.tolist(), p.x2.tolist(), p.y2.tolist(), strict=True))
                made.append(pixels.to_png(outlined(pixels.from_source(p.data, p.width, p.height, p.nChannels), rects, [] if p.x1 is None else list(p.color))))
            yield pdf[PAGE].assign(image=made)

    return flat.mapInPandas(run, IMAGE)


def overlay_rows(images: DataFrame, stem: Column, kind: str = "diagnostic") -> DataFrame:
    """path and content for the file sink: diagnostics/<stem>_diagnostic.png of layouts, diagnosis/<stem>_diagnosis.png of
    grounding tags."""
    folder = {"diagnostic": "diagnostics", "diagnosis": "diagnosis"}[kind]
    return images.select(F.concat("doc_id", F.lit(f"/{folder}/"), stem, F.lit(f"_{kind}.png")).alias("path"), F.col("image").alias("content"))
