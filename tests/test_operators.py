"""Operators on worked examples, and windows against plain folds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.functions.text import full_to_half
from docflow.operators import boxes, ground, html_tables, infer, mask, pixels, reflow, render, skew
from docflow.operators.order import reading_order
from docflow.sources import files

HYPHENS = "-­‐‑⁃"
ENDS = '.!?。！？…”"'


def cjk(c):
    return "一" <= c <= "鿿" if c else False


def fold_lines(text):
    """The reflow, one line after another with a buffer."""
    out, buffer, code = [], None, False
    for line in text.split("\n"):
        s = line.strip()
        plain = False
        if s.startswith("```"):
            code = not code
        elif not code and s and not re.match(r"#|- |\* |> |\||<table|</table|\$\$|[0-9]+\.|(Figure|Fig\.|Table)\s*[0-9]+", s):
            plain = True
        if not plain:
            if buffer is not None:
                out.append(buffer)
            buffer = None
            out.append(line)
        elif buffer is None:
            buffer = line
        else:
            p = buffer.rstrip()[-1]
            if p in HYPHENS:
                buffer = buffer.rstrip().rstrip(HYPHENS) + s
            elif p not in ENDS and s[0].islower():
                buffer += " " + s
            elif cjk(p) and cjk(s[0]):
                buffer += s
            else:
                out.append(buffer)
                buffer = line
    return "\n".join(out + ([buffer] if buffer is not None else []))


def fold_pages(pages):
    result, seen = "", False
    for i, page in enumerate(pages):
        s = page.strip()
        if not s:
            continue
        if not seen:
            result, seen = (page if i == 0 else s), True
            continue
        p = result.rstrip()[-1:]
        if p and p in HYPHENS:
            result = result.rstrip().rstrip(HYPHENS) + s
        elif (p.isalpha() or p == ",") and s[0].islower():
            result += " " + s
        elif cjk(p) and cjk(s[0]):
            result += s
        else:
            result += "\n\n" + page
    return result


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_full_width(spark):
    assert one(spark, "Ｔｅｓｔ １２３！ ＋＝ ａｂｃ", full_to_half) == "Test 123！ ＋＝ abc"


@pytest.mark.parametrize(
    "text, expected",
    [("infor-­\nmation", "information"), ("---\ntext", "text"), ("foo  \nbar", "foo   bar"), ("well-\nKnown", "wellKnown"), ("漢\n字", "漢字"), ("End.\nnext", "End.\nnext"), ("- a\nb", "- a\nb"), ("", ""), (None, "")],
)
def test_reflow_examples(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert reflow.reflow(df, ["doc_id"]).first().text == expected


def test_reflow_is_the_fold(spark):
    r = random.Random(5)
    bits = ["a", "b-", "Cd", "漢", ".", "", " ", "```", "- x", "1. y", "x ", "­", "\t", "foo,", "# t", "Fig. 3"]
    texts = ["\n".join("".join(r.choice(bits) for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: x.text for x in reflow.reflow(df, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [fold_lines(t) for t in texts]


@pytest.mark.parametrize("pages, expected", [(["conn-", "ect"], "connect"), (["a,", "b"], "a, b"), (["1", "b"], "1\n\nb"), (["", " x"], "x"), ([" ", ""], "")])
def test_stitch_examples(spark, pages, expected):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "doc_id int, page_idx int, text string")
    assert reflow.stitch(df).first().text == expected


def test_stitch_is_the_fold(spark):
    r = random.Random(6)
    bits = ["a", "b-", "C", "漢", ",", ".", " ", "\n", "1"]
    docs = [["".join(r.choice(bits) for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 6))] for _ in range(1500)]
    df = spark.createDataFrame([(d, i, p) for d, pages in enumerate(docs) for i, p in enumerate(pages)], "doc_id int, page_idx int, text string")
    got = {x.doc_id: x.text for x in reflow.stitch(df).collect()}
    assert [got[i] for i in range(len(docs))] == [fold_pages(p) for p in docs]


def test_reading_order_examples():
    columns = {"C": (220, 15, 400, 95), "B": (10, 120, 190, 200), "D": (220, 110, 400, 210), "A": (10, 10, 190, 100)}
    assert [list(columns)[i] for i in reading_order(list(columns.values()), False)] == ["A", "B", "C", "D"]
    ledger = {"A": (200, 10, 350, 50), "B": (10, 100, 400, 250), "C": (10, 300, 150, 340), "D": (200, 290, 350, 330)}
    assert [list(ledger)[i] for i in reading_order(list(ledger.values()), True)] == ["A", "B", "C", "D"]
    grid = [(x * 100, y * 100, x * 100 + 50, y * 100 + 50) for y in range(2) for x in range(3)]
    assert reading_order(grid, False) == [0, 3, 1, 2, 4, 5]
    assert reading_order([], False) == [] and reading_order([(0, 0, 1, 1)], True) == [0]


def box_table(spark, rows, size=300):
    return spark.createDataFrame([("d", 0, i, 0.9, "text", *r, size, size) for i, r in enumerate(rows)], "doc_id string, page_idx int, det_idx int, score double, label string, x1 int, y1 int, x2 int, y2 int, page_w int, page_h int")


def masked(spark, rows, target):
    df = box_table(spark, rows)
    crop = mask.crops(df).where(f"det_idx = {target}").first()
    pairs = mask.overlaps(df)
    rects = [tuple(r) for m in (mask.core_masks(pairs), mask.ring_masks(pairs)) for r in m.where(f"det_idx = {target}").select("x1", "y1", "x2", "y2").collect()]
    image = np.zeros((300, 300, 3), np.uint8)[crop.py1 : crop.py2, crop.px1 : crop.px2]
    image = pixels.blank(image, rects)
    return crop, pixels.resize(image, crop.out_w, crop.out_h) if crop.out_h != image.shape[0] else image


def test_masks(spark):
    crop, image = masked(spark, [(20, 20, 100, 100), (80, 80, 180, 180)], 0)
    assert (crop.px1, crop.py1, crop.px2, crop.py2) == (14, 14, 106, 106)
    assert image[80, 80].tolist() == [0] * 3 and image[80, 90].tolist() == [255] * 3 and image[90, 80].tolist() == [255] * 3
    _, image = masked(spark, [(20, 20, 100, 50), (80, 30, 180, 180)], 0)
    assert image.shape[0] == 128 and image[64, image.shape[1] - 15].tolist() == [255] * 3
    _, image = masked(spark, [(80, 80, 100, 100), (0, 0, 200, 200)], 1)
    assert image[85, 85].tolist() == [255] * 3


def test_detections(spark):
    df = spark.createDataFrame([("d", 0, [0.95, 0.4, 0.39, float("nan")], [0, 7, 0, 1], [[10.9, 10.0, 100.0, 100.0], [-1.9, 0.0, 5.0, 5.0], [0.0] * 4, [1.0] * 4]), ("d", 1, None, [0], [[0.0] * 4])], "doc_id string, page_idx int, scores array<double>, labels array<int>, boxes array<array<double>>")
    rows = boxes.detections(df, {0: "text", 1: "table"}).orderBy("det_idx").collect()
    assert [(r.det_idx, r.label, r.x1) for r in rows] == [(0, "text", 10), (1, "Label_7", -1), (2, "table", 1)]


def test_headers_go_without_tables(spark):
    rows = [("d", p, i, x) for p, labels in ((0, ["header", "text", "FOOTER"]), (1, ["Header", "TABLE", "footer"])) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, det_idx int, label string")
    assert {(r.page_idx, r.label) for r in boxes.drop_headers(df).collect()} == {(0, "text"), (1, "Header"), (1, "TABLE")}
    assert boxes.drop_headers(df, keep=True).count() == 6


def test_ground(spark):
    df = spark.createDataFrame([("p", "table[[10, 20, 80, 90]] x chart[[5, 5, 50, 50]] image[[15, 15, 60, 60]] image_caption[[1, 1, 9, 9]]", 100, 100)], "page string, text string, page_w int, page_h int")
    found = ground.tags(df, ["page"]).orderBy("pos").collect()
    assert [(r["class"], r.x1, r.y1, r.x2, r.y2) for r in found] == [("table", 1, 2, 8, 9), ("chart", 0, 0, 5, 5), ("image", 1, 1, 6, 6), (None, 0, 0, 0, 0)]
    text = ground.rewrite(df, ["page"], F.lit("test_page")).first().text
    assert all(f"![{c}](images/test_page_{c}_1.png)" in text for c in ("table", "chart", "image")) and "[[" not in text and "\n\n\n" not in text


def test_skew(spark):
    lines = [("p", 50, 100, 350, 126), ("p", 50, 200, 350, 226), ("p", 0, 0, 0, 9), ("q", 0, 0, 0, 9)]
    got = {r.page: r.skew for r in skew.skew(spark.createDataFrame(lines, "page string, x1 int, y1 int, x2 int, y2 int"), ["page"]).collect()}
    assert abs(got["p"] - 4.95) < 0.01 and got["q"] == 0


def test_png_is_what_the_image_source_reads(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 255, (9, 7, 3)).astype(np.uint8)
    for name in ("page_00002.png", "page_00010.png"):
        (tmp_path / name).write_bytes(pixels.to_png(image))
    (tmp_path / "other.txt").write_text("x")
    r = files.decoded_images(spark, str(tmp_path)).first()
    assert (pixels.from_source(bytes(r.data), r.width, r.height, r.nChannels) == image).all()
    pages = files.page_files(spark, str(tmp_path)).orderBy("page_idx").collect()
    assert [(p.page_idx, p.page_no, p.stem) for p in pages] == [(0, 2, "page_00002"), (1, 10, "page_00010")]
    assert files.image_files(spark, str(tmp_path)).count() == 2
    assert files.input_pages(spark, str(tmp_path / "page_00002.png"), "").first().stem == "page_00002"


@pytest.mark.parametrize("text, expected", [("1, 3-5, 10", [0, 2, 3, 4, 9]), ("", None), ("a, 1-2-3, -5, 2", [1]), ("5-3", []), ("0,1", [0])])
def test_page_selection(spark, text, expected):
    assert one(spark, text, files.selected_pages) == expected


def test_pruning_falls_back_to_all(spark):
    df = spark.createDataFrame([(3, [9]), (3, [1, 9]), (3, None), (0, [1])], "n int, s array<int>")
    assert [r.x for r in df.select(files.pruned_pages(F.col("n"), F.col("s")).alias("x")).collect()] == [[0, 1, 2], [1], [0, 1, 2], []]


def test_html_tables(spark):
    html = "a<TABLE><tr><th>x</th><th>y|z</th></tr>\n<tr><td>1</td></tr></table>b<table></table>"
    df = spark.createDataFrame([(1, html)], "id int, text string")
    assert html_tables.rewrite_tables(df, ["id"]).first().text == "a\n\n| x | y\\|z |\n| --- | --- |\n| 1 |  |\n\nb\n\n\n\n"


def test_positional_fill(spark):
    blocks = spark.createDataFrame([("d", 0, i, k, "Text") for i, k in enumerate(["ocr", "image", "ocr", "ocr"])], "doc_id string, page_idx int, block_idx int, kind string, label string")
    texts = spark.createDataFrame([("d", 0, 0, "a```"), ("d", 0, 1, "b")], "doc_id string, page_idx int, n int, content string")
    got = {r.block_idx: r.content for r in render.fill_by_place(blocks, texts).collect()}
    assert got == {0: "a", 1: None, 2: "b", 3: "[OCR识别失败：索引溢出，标签为: Text]"}


def test_both_dialects_of_the_nested_form(spark):
    legacy = '{"pdf_info":[{"page_idx":0,"page_size":[5,6],"blocks":[{"type":"Doc_Title","content":"T"},{"type":"figure","image_path":"p.png"}]}]}'
    df = spark.createDataFrame([("a", legacy), ("b", "{}"), ("c", "not json")], "doc_id string, json string")
    pages, blocks = render.from_middle(df)
    assert pages.count() == 1 and [(b.block_idx, b.kind, b.label) for b in blocks.orderBy("block_idx").collect()] == [(0, "ocr", "doc_title"), (1, "image", "figure")]
    assert render.render_pages(pages, blocks, "cached").first().markdown == "\n\n# T\n\n\n\n\n\n![figure](p.png)\n\n"


def test_settings():
    s = files.Settings.from_env({"VLLM_API_URL": "http://h/v1/chat/completions"})
    assert s.models_url == "http://h/v1/models" and files.output_folder("/x/a.b.pdf") == "ocr_output/a.b"


def test_pages_of_cached_documents_keep_their_white_space(spark):
    """By hand: blocks bring their own blank lines, and pages are joined as they are."""
    df = spark.createDataFrame([(1, 1, "\n\n![figure](a.png)\n\n"), (1, 0, "\n\nText\n\n\n\n\n\nmore\n\n"), (1, 2, "")], "doc_id long, page_idx int, text string")
    text = reflow.merge_pages(df, "cached").first().text
    assert text == "\n\nText\n\n\n\n\n\nmore\n\n" + "\n\n\\newpage\n\n" + "\n\n![figure](a.png)\n\n" + "\n\n\\newpage\n\n"
