"""Crops of pages: the sheet of masks against plain rectangles, worked examples, and files."""

import random

import numpy as np
import pytest

from docflow.operators import crops, pixels
from docflow.sources import files, file_sink

BOX = "doc_id string, page_idx int, det_idx int, label string, kind string, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int"
PICTURE = "doc_id string, page_idx int, width int, height int, nChannels int, data binary"


def test_the_sheet_is_plain_rectangles():
    r = random.Random(3)
    for _ in range(40):
        sizes = [(r.randint(1, 30), r.randint(1, 30)) for _ in range(r.randint(0, 6))]
        rects = [[(r.randint(-5, 35), r.randint(-5, 35), r.randint(-5, 40), r.randint(-5, 40)) for _ in range(r.randint(0, 5))] for _ in sizes]
        for (w, h), own, found in zip(sizes, rects, crops.painted(sizes, rects), strict=True):
            plain = np.zeros((h, w), bool)
            for x1, y1, x2, y2 in own:
                plain[max(y1, 0) : max(y2 + 1, 0), max(x1, 0) : max(x2 + 1, 0)] = True
            assert (found == plain).all()


def made(spark, rows, size=300, kinds=None, color=0, page=("d", 0)):
    table = [(*page, i, "text", (kinds or {}).get(i, "ocr"), *r, size, size) for i, r in enumerate(rows)]
    picture = [(*page, size, size, 3, bytearray(np.full((size, size, 3), color, np.uint8).tobytes()))]
    return crops.crop_images(spark.createDataFrame(picture, PICTURE), spark.createDataFrame(table, BOX))


def image_of(row, spark, tmp_path):
    (tmp_path / "x.png").write_bytes(row.image)
    r = files.decoded_images(spark, str(tmp_path / "x.png")).first()
    return pixels.from_source(bytes(r.data), r.width, r.height, r.nChannels)


def test_neighbours_are_blanked_out(spark, tmp_path):
    first = made(spark, [(20, 20, 100, 100), (80, 80, 180, 180)]).where("det_idx = 0").first()
    image = image_of(first, spark, tmp_path)
    assert image.shape == (92, 92, 3)
    assert image[80, 80].tolist() == [0] * 3 and image[80, 90].tolist() == [255] * 3 and image[90, 80].tolist() == [255] * 3


def test_small_crops_are_scaled_up(spark, tmp_path):
    first = made(spark, [(20, 20, 100, 50), (80, 30, 180, 180)]).where("det_idx = 0").first()
    image = image_of(first, spark, tmp_path)
    assert image.shape[0] == 128 and image[64, image.shape[1] - 15].tolist() == [255] * 3


def test_small_boxes_are_wiped_out_of_large_ones(spark, tmp_path):
    found = {r.det_idx: r for r in made(spark, [(80, 80, 100, 100), (0, 0, 200, 200)]).collect()}
    assert image_of(found[1], spark, tmp_path)[85, 85].tolist() == [255] * 3
    assert found[1].n_white == 21 * 21


def test_pictures_are_cut_as_they_are(spark):
    found = {r.det_idx: r for r in made(spark, [(80, 80, 100, 110), (0, 0, 200, 200), (290, 290, 310, 305), (5, 5, 5, 9), (-4, -3, 6, 6)], kinds={0: "image", 2: "image", 3: "image", 4: "image"}, color=9).collect()}
    assert {k: (found[k].width, found[k].height, found[k].n_white) for k in (0, 2, 4)} == {0: (20, 30, 0), 2: (20, 15, 0), 4: (10, 9, 0)}
    assert found[3].image is None and (found[3].width, found[3].height) == (0, 4)


def test_pages_without_picture_or_boxes(spark):
    boxes = spark.createDataFrame([("d", 0, 0, "text", "ocr", 1, 1, 9, 9, 20, 20)], BOX)
    pictures = spark.createDataFrame([("d", 1, 20, 20, 3, bytearray(1200))], PICTURE)
    assert crops.crop_images(pictures, boxes).collect() == []


def test_crops_become_files(spark, tmp_path):
    found = made(spark, [(80, 80, 100, 110), (0, 0, 200, 200)], kinds={0: "image"})
    names = spark.createDataFrame([("d", 0, 0, "images/p_fig_1.png")], "doc_id string, page_idx int, det_idx int, image_path string")
    file_sink.write_files(crops.crop_rows(found, names), str(tmp_path / "out"))
    read = files.decoded_images(spark, str(tmp_path / "out"), deep=True).collect()
    assert [(r.origin.split("/out/")[1], r.width, r.height) for r in read] == [("d/images/p_fig_1.png", 20, 30)]


def test_resampling():
    flat = np.full((7, 5, 3), 93, np.uint8)
    assert (pixels.resize(flat, 31, 17) == 93).all() and pixels.resize(flat, 31, 17).shape == (17, 31, 3)
    ramp = np.repeat(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(4, axis=0)
    up = pixels.resize(ramp, 200, 4)[0, :, 0].astype(int)
    assert (np.diff(up) >= 0).all() and abs(up[20:180] - (np.arange(200) - 0.5)[20:180]).max() <= 1  # linear stays linear
    small = pixels.thumbnail(ramp.repeat(40, axis=1), 400)
    assert small.shape == (1, 400, 3) or small.shape[1] == 400
    assert abs(small[0, 100:300, 0].astype(int) - np.linspace(0, 199, 400)[100:300]).max() <= 2
    assert pixels.thumbnail(ramp, 400) is ramp


@pytest.mark.parametrize("parts", [1, 4])
def test_ranks_need_no_single_task(spark, tmp_path, parts):
    names = [f"page_{k:05d}.png" for k in range(1, 40)]
    for n in names:
        (tmp_path / n).write_bytes(b"x" + n.encode())
    found = files.page_files(spark, str(tmp_path), parts=parts)
    assert [(r.page_idx, r.page_no, bytes(r.content)) for r in found.orderBy("page_idx").collect()] == [(k, k + 1, b"x" + n.encode()) for k, n in enumerate(names)]
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_whole_texts_are_read(spark, tmp_path):
    (tmp_path / "page_1.md").write_text("a\nb\n")
    (tmp_path / "x.json").write_text('{\n "pdf_info": []\n}')
    assert [tuple(r) for r in files.page_texts(spark, str(tmp_path)).collect()] == [("page_1.md", "a\nb\n")]
    assert [tuple(r) for r in files.middle_texts(spark, str(tmp_path)).collect()] == [("x", '{\n "pdf_info": []\n}')]
