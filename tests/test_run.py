"""From files to documents, end to end, with stand-ins for models."""

import json
import os
import struct

import numpy as np
import pytest

from docflow import run
from docflow.operators import infer, pixels
from docflow.sources.pdf_write import packed_pdf, pdf


class Layout:
    """Says by the picture's width what is on the page."""

    LABELS = {0: "doc_title", 1: "figure", 2: "header", 3: "footer", 4: "Table"}

    def detect(self, images):
        out = []
        for image in images:
            width, height = struct.unpack(">II", image[16:24])
            if width == 77:
                raise ValueError("no layout")
            found = [[10, 20, 60, 40], [10, 50, 90, 90], [0, 0, 90, 8], [0, 92, 90, 99], [10, 100, 60, 140]]
            out.append(([0.9] * 5, [0, 1, 2, 3, 4], found) if width == 100 else ([0.9], [0], [[5, 5, 40, 30]]))
        return out


def draw(path, page_idx, dpi):
    if page_idx == 2:
        raise RuntimeError("no such font")
    if path.endswith("strange.pdf"):
        return b"no picture" if page_idx else pixels.to_png(np.full((20, 77, 3), 250, np.uint8))
    return pixels.to_png(np.full((150, 100, 3), 200 + page_idx, np.uint8))


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    (source / "OCR_Output_old").mkdir(parents=True)
    (source / "report.pdf").write_bytes(pdf([(100, 150)] * 3))
    (source / "strange.pdf").write_bytes(packed_pdf([(100, 150)] * 2))
    (source / "broken.pdf").write_bytes(b"nothing")
    (source / "photo.png").write_bytes(pixels.to_png(np.full((60, 50, 3), 99, np.uint8)))
    (source / "OCR_Output_old/earlier.png").write_bytes(b"x")
    return str(source), str(tmp_path / "out")


def tree(out):
    return sorted(os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(out) for f in names)


def text(out, doc):
    with open(f"{out}/{doc}/final_output.md", encoding="utf-8") as f:
        return f.read()


OPTIONS = dict(labels=Layout.LABELS, renderer="test_run:draw", policy=infer.DRY)


def test_files_become_documents_and_are_rendered_again(spark, folder, monkeypatch):
    monkeypatch.syspath_prepend(os.path.dirname(__file__))
    monkeypatch.setenv("PYTHONPATH", os.pathsep.join([os.path.dirname(__file__), os.environ.get("PYTHONPATH", "")]))
    spark.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
    source, out = folder
    progress = run.process(spark, source, out, Layout, infer.EchoRecognizer, run.Options(**OPTIONS))
    report = [f"report/diagnostics/page_0000{k}_diagnostic.png" for k in (1, 2)] + ["report/final_output.md"] + [f"report/images/page_0000{k}_{t}_1.png" for k in (1, 2) for t in ("fig", "table")] + ["report/report_middle.json"]
    assert [p for p in tree(out) if p.startswith("report/")] == report
    assert {p.split("/")[0] for p in tree(out)} == {"report", "strange", "broken", "photo"}
    first = text(out, "report").split("\\newpage")
    assert len(first) == 3 and "# Text Recognition: 1024 " in first[0] and "![figure](images/page_00001_fig_1.png){width=100%}" in first[0]
    assert "![header]" not in first[0] and first[0].count("Text Recognition") == 2  # the page has a table, so its header stays
    assert "[Layout分析异常: no such font]" in first[2]
    strange = text(out, "strange").split("\\newpage")
    assert "[Layout分析异常: no layout]" in strange[0] and "[Layout分析异常: not a picture]" in strange[1]
    assert "[Layout分析异常: no cross-reference table]" in text(out, "broken") and "# Text Recognition: 1024 " in text(out, "photo")
    middle = json.load(open(f"{out}/report/report_middle.json", encoding="utf-8"))
    assert [p["page_size"] for p in middle["pdf_info"]] == [[100, 150], [100, 150], [100, 100]]
    assert [b["label"] for b in middle["pdf_info"][0]["blocks"]] and "page_idx" in middle["pdf_info"][0]
    assert progress.stages["recognition"].counts["failed"] == 0 and progress.stages["layout"].counts == {"completed": 4, "succeeded": 3, "failed": 1}

    def never():
        raise AssertionError("a model was asked for")

    os.remove(f"{out}/photo/photo_middle.json")
    with open(f"{out}/broken/broken_middle.json", "w") as f:
        f.write("{ not json")
    again = run.process(spark, source, out, Layout, infer.EchoRecognizer, run.Options(**OPTIONS))
    assert again.stages["layout"].counts["completed"] == 1  # the photo; the broken file has no picture
    assert "# Text Recognition" not in text(out, "report") or "{width=" not in text(out, "report")
    assert "![image_block]" not in text(out, "report") and "(images/page_00001_fig_1.png)" in text(out, "report")
    third = run.process(spark, source, out, never, never, run.Options(**OPTIONS))
    assert third.stages["layout"].counts.get("completed", 0) == 0


def test_tables_as_text_headers_kept_and_pages_chosen(spark, folder, monkeypatch):
    monkeypatch.syspath_prepend(os.path.dirname(__file__))
    source, out = folder
    progress = run.process(spark, f"{source}/report.pdf", out, Layout, infer.EchoRecognizer, run.Options(**OPTIONS, force=True, ocr_table=True, keep_header_footer=True, pages="2"))
    found = text(out, "report")
    assert found.count("Text Recognition") == 3 and found.count("Table Recognition: 4096") == 1 and "\\newpage" in found
    assert progress.stages["recognition"].counts["completed"] == 4
    run.process(spark, f"{source}/photo.png", out, Layout, infer.EchoRecognizer, run.Options(**OPTIONS))
    assert [p for p in tree(out) if p.startswith("photo")] == ["photo/diagnostics/photo_diagnostic.png", "photo/final_output.md", "photo/photo_middle.json"]
