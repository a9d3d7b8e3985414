"""Pictures of boxes: cut out of page pictures, with what neighbours show in them blanked out, and as rows for files.

Pages meet their boxes in a cogroup on the page. All crops of a page lie below each other on one sheet; a difference
array over the sheet takes four entries a mask, and its running sums along both axes paint all masks in one pass,
whatever their number and overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docflow.operators import mask, pixels

PAGE = ["doc_id", "page_idx"]
CORNERS = ["x1", "y1", "x2", "y2"]
CROP = "doc_id string, page_idx int, det_idx int, kind string, width int, height int, n_white int, image binary"


def with_masks(boxes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Boxes with the columns of ``mask.crops`` and masks: the rectangles to blank out in the crop, corners included."""
    pairs = mask.overlaps(boxes, others)
    rects = mask.core_masks(pairs).unionByName(mask.ring_masks(pairs).drop("side"))
    listed = rects.groupBy(*PAGE, "det_idx").agg(F.collect_set(F.array("x1", "y1", "x2", "y2")).alias("masks"))
    return mask.crops(boxes).join(listed, [*PAGE, "det_idx"], "left")


def painted(sizes: list[tuple[int, int]], rects: list[list[tuple[int, int, int, int]]]) -> list[np.ndarray]:
    """For crops of (width, height) and their rectangles, both corners included: which of each crop's pixels are covered."""
    width, tops = max((w for w, _ in sizes), default=0), np.cumsum([0, *(h for _, h in sizes)])
    marks = [(top + max(y1, 0), max(x1, 0), top + min(y2 + 1, h), min(x2 + 1, w)) for (w, h), top, own in zip(sizes, tops, rects, strict=False) for x1, y1, x2, y2 in own if max(x1, 0) < min(x2 + 1, w) and max(y1, 0) < min(y2 + 1, h)]
    steps = np.zeros((tops[-1] + 1, width + 1), np.int32)
    if marks:
        y1, x1, y2, x2 = np.array(marks).T
        for y, x, step in ((y1, x1, 1), (y2, x2, 1), (y1, x2, -1), (y2, x1, -1)):
            np.add.at(steps, (y, x), step)
    sheet = steps.cumsum(axis=0).cumsum(axis=1) > 0
    return [sheet[top : top + h, :w] for (w, h), top in zip(sizes, tops, strict=False)]


def window(page: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """What a page shows between two corners; black where that leaves the page."""
    h, w = page.shape[:2]
    out = page[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
    if x1 < 0 or y1 < 0 or x2 > w or y2 > h:
        out = np.pad(out, ((max(-y1, 0), max(y2 - max(h, y1), 0)), (max(-x1, 0), max(x2 - max(w, x1), 0)), (0, 0)))[: max(y2 - y1, 0), : max(x2 - x1, 0)]
    return out


def cut(page: np.ndarray, boxes: pd.DataFrame) -> list[np.ndarray]:
    """The crops of a page's boxes: pictures as they are, the others padded, with their masks white."""
    plain = boxes["kind"] == "image"
    x1, y1, x2, y2 = (np.where(plain, boxes[c], boxes[f"p{c}"]).astype(int) for c in ("x1", "y1", "x2", "y2"))
    out = [window(page, *corners) for corners in zip(x1, y1, x2, y2, strict=True)]
    rects = [[] if p or m is None or isinstance(m, float) else [tuple(r) for r in m] for p, m in zip(plain, boxes["masks"], strict=True)]
    covered = painted([(i.shape[1], i.shape[0]) for i in out], rects)
    return [np.where(m[..., None], np.uint8(255), i) for i, m in zip(out, covered, strict=True)]


def _page_rows(page: np.ndarray, kinds: list, corners: np.ndarray, wide: list, high: list, masks: list) -> list[tuple]:
    """width, height, n_white and image of CROP for each box of a page; corners: x1, y1, x2, y2 of what is cut, a row a box."""
    cuts = [tuple(c) for c in corners.tolist()]
    # a grey page is one channel until its files are made, and what is white in it is told once
    plain = pixels.grey(page)
    inked = page[..., :1] if plain else page
    white = (inked == 255).all(axis=2, keepdims=True)
    made, whites = [window(inked, *c) for c in cuts], [window(white, *c)[..., 0] for c in cuts]
    rows = []
    for image, seen, covered, kind, w, h in zip(made, whites, painted([(i.shape[1], i.shape[0]) for i in made], masks), kinds, wide, high, strict=True):
        image = np.where(covered[..., None], np.uint8(255), image)
        n_white = int(np.count_nonzero(seen | covered))
        if kind != "image" and image.size and h != image.shape[0]:
            image = pixels.resize(image, int(w), int(h))
        rows.append((image.shape[1], image.shape[0], n_white, pixels.to_png(np.repeat(image, 3, axis=2) if plain else image) if image.size else None))
    return rows


def _page_crops(page: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in CROP.split(", ")]
    if page.empty or boxes.empty:
        return pd.DataFrame(columns=names)
    p = page.iloc[0]
    plain = (boxes["kind"] == "image").to_numpy()
    corners = np.stack([np.where(plain, boxes[c], boxes[f"p{c}"]).astype(int) for c in CORNERS], axis=1)
    masks = [[] if k or m is None or isinstance(m, float) else [tuple(r) for r in m] for k, m in zip(plain, boxes["masks"], strict=True)]
    rows = _page_rows(pixels.from_source(p["data"], p["width"], p["height"], p["nChannels"]), list(boxes["kind"]), corners, list(boxes["out_w"]), list(boxes["out_h"]), masks)
    keys = boxes[[*PAGE, "det_idx", "kind"]].reset_index(drop=True)
    return pd.concat([keys, pd.DataFrame(rows, columns=names[4:])], axis=1)


KEEP = ["det_idx", "kind", "x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2", "out_w", "out_h", "masks"]


def listed(boxes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """doc_id, page_idx, boxes: a page's boxes with their masks, to be joined to pages before their pictures are read; then
    no pictures are sent to them."""
    met = with_masks(boxes, others).withColumn("masks", F.flatten("masks"))
    return met.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*KEEP))).alias("b")).select(*PAGE, F.struct(*(F.col(f"b.{c}").alias(c) for c in KEEP)).alias("boxes"))


def crops_of(pages: DataFrame) -> DataFrame:
    """``crop_images`` for pages that have their ``boxes`` (of ``listed``; null: none) beside their pictures."""
    flat = pages.where("boxes IS NOT NULL").select(*PAGE, "width", "height", "nChannels", "data", *(F.col(f"boxes.{c}").alias(c) for c in KEEP))

    names = [c.split()[0] for c in CROP.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[tuple] = []
            for p in pdf.itertuples(index=False):
                kinds = list(p.kind)
                plain = np.array([k == "image" for k in kinds], bool)
                corners = np.stack([np.where(plain, getattr(p, c), getattr(p, f"p{c}")).astype(int) for c in CORNERS], axis=1)
                masks = [[] if k or m is None else [tuple(r) for r in np.asarray(m, int).reshape(-1, 4).tolist()] for k, m in zip(plain, p.masks, strict=True)]
                made = _page_rows(pixels.from_source(p.data, p.width, p.height, p.nChannels), kinds, corners, list(p.out_w), list(p.out_h), masks)
                rows += [(p.doc_id, p.page_idx, n, kind, *row) for n, kind, row in zip(p.det_idx, kinds, made, strict=True)]
                if len(rows) >= 500:  # a frame for each page costs more than its crops
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return flat.mapInPandas(run, CROP)


def crop_images(pages: DataFrame, boxes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Rows of CROP, one for each box (with kind: image or ocr; page_w, page_h) of a page with a decoded picture (width,
    height, nChannels, data as the image source gives them).

    Pictures are cut at their corners. Ocr blocks are padded, blanked out, and scaled up if under 64 high; n_white counts
    white pixels before that. Boxes of pages without a picture have no row, empty crops no image. ``others``: all boxes
    that can show in a crop, if ``boxes`` is a part of them.
    """
    # keys under new ids, as pages and boxes may come from one table
    left = pages.select(*(F.col(c).alias(c) for c in PAGE), "width", "height", "nChannels", "data").groupBy(*PAGE)
    keep = [*PAGE, "det_idx", "kind", "x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2", "out_w", "out_h", "masks"]
    return left.cogroup(with_masks(boxes, others).select(*keep).groupBy(*PAGE)).applyInPandas(_page_crops, CROP)


def crop_rows(crops: DataFrame, names: DataFrame) -> DataFrame:
    """path and content of picture crops for the file sink; names: doc_id, page_idx, det_idx, image_path."""
    met = crops.where("kind = 'image' AND image IS NOT NULL").join(names, [*PAGE, "det_idx"])
    return met.select(F.concat("doc_id", F.lit("/"), "image_path").alias("path"), F.col("image").alias("content"))


def picture_rows(pages: DataFrame, pictures: DataFrame) -> DataFrame:
    """path and content for the file sink of the pictures of pages in PNG files, cut at their corners. pages: PAGE and
    content; pictures: doc_id, page_idx, image_path and x1, y1, x2, y2 of boxes of kind image.

    A page's boxes go to its file, and its pixels are only made where they are cut. Empty crops have no row."""
    return pictures_of(pages.join(picture_lists(pictures), PAGE))


CUT = ["image_path", "x1", "y1", "x2", "y2"]


def picture_lists(pictures: DataFrame) -> DataFrame:
    """doc_id, page_idx, cuts: a page's pictures of ``picture_rows``, to be joined to the names of pages' files before these
    are read; then no contents are sent to them."""
    return pictures.groupBy(*PAGE).agg(F.collect_list(F.struct(*CUT)).alias("cuts"))


def pictures_of(pages: DataFrame) -> DataFrame:
    """``picture_rows`` for pages that have their ``cuts`` (of ``picture_lists``) beside their content."""
    names = CUT
    met = pages.select("doc_id", "content", *(F.col(f"cuts.{c}").alias(c) for c in names))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, content, paths, *places in zip(pdf["doc_id"], pdf["content"], *(pdf[c] for c in names), strict=True):
                page = pixels.from_png(content)
                for path, *at in zip(paths, *places, strict=True):
                    image = window(page, *map(int, at))
                    if image.size:
                        rows.append((f"{doc}/{path}", pixels.to_png(image)))
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "content"])

    return met.mapInPandas(run, "path string, content binary")


def png(data: str, width: str, height: str, channels: str) -> Column:
    """Decoded pictures as PNG files."""
    return _png(data, width, height, channels)


@F.pandas_udf(BinaryType())
def _png(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([pixels.to_png(pixels.from_source(*row)) for row in zip(data, width, height, channels, strict=True)])
