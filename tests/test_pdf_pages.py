"""PDF pages: the page tree in both layouts, partitions of wanted pages only, broken files and pages as rows."""

import io
import random

import pytest
from pyspark.sql import functions as F

from docflow.sources.pdf_index import Parser, PdfIndex, Ref
from docflow.sources.pdf_pages import pdf_pages
from docflow.sources.pdf_write import packed_pdf, pdf


def sizes(n, seed=0):
    r = random.Random(seed)
    return [(r.randint(100, 900), r.randint(100, 900)) for _ in range(n)]


@pytest.mark.parametrize("make", [pdf, packed_pdf])
@pytest.mark.parametrize("n", [1, 8, 9, 73, 700])
def test_page_tree(make, n):
    index = PdfIndex(io.BytesIO(make(sizes(n))))
    assert len(index) == n
    assert list(index.pages(list(range(n)))) == [(k, *map(float, s)) for k, s in enumerate(sizes(n))]
    assert [k for k, _, _ in index.pages([0, n - 1][: min(n, 2)])] == sorted({0, n - 1})


def test_few_nodes_are_read():
    class Counting(io.BytesIO):
        reads = 0

        def read(self, *a):
            Counting.reads += 1
            return super().read(*a)

    file = Counting(pdf(sizes(4000)))
    index = PdfIndex(file)
    before = Counting.reads
    assert [k for k, _, _ in index.pages([3999])] == [3999]
    assert Counting.reads - before < 60


def test_inherited_boxes_rotation_and_updates():
    body = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count 3 /Kids [3 0 R 4 0 R 5 0 R] /MediaBox [10 20 110 220] /Rotate 90 % a comment\n >>",
        b"<< /Type /Page /Parent 2 0 R >>",
        b"<</Type/Page/Rotate 0/CropBox[0 0 5.5 .5]/Title(a\\)b(c))/ID<4a4B5>>>",
        b"<< /Type /Page /Rotate 6 0 R >>",
        b"180",
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number, one in enumerate(body, 1):
        places.append(len(out))
        out += b"%d 0 obj\r\n%b\nendobj\n" % (number, one)
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n1 6\n" + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer << /Root 1 0 R /Size 7 >>\nstartxref\n%d\n%%%%EOF\n" % start
    index = PdfIndex(io.BytesIO(bytes(out)))
    assert list(index.pages([0, 1, 2])) == [(0, 200.0, 100.0), (1, 5.5, 0.5), (2, 100.0, 200.0)]
    # a later version of page 3
    at = len(out)
    out += b"3 0 obj\n<< /Type /Page /MediaBox [0 0 7 9] /Rotate 0 >>\nendobj\n"
    second = len(out)
    out += b"xref\n3 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Size 7 /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, start, second)
    assert list(PdfIndex(io.BytesIO(bytes(out))).pages([0])) == [(0, 7.0, 9.0)]


def test_values():
    assert Parser(b"[1 -2 +.5 3 0 R 4 0 RX true null /A#20b (x) <4> ]").value() == [1, -2, 0.5, Ref((3, 0)), 4, 0, b"RX", True, None, "A b", b"x", b"\x40"]
    with pytest.raises(EOFError):
        Parser(b"<< /A [1 2").value()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "long.pdf").write_bytes(pdf(sizes(500, 1)))
    (tmp_path / "sub/short.PDF").write_bytes(packed_pdf(sizes(3, 2)))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def test_rows(spark, folder):
    rows = pdf_pages(spark, folder, dpi=36, renderer="docflow.sources.pdf_pages:blank_page").collect()
    assert len(rows) == 504
    found = {(r.doc_id, r.page_idx): r for r in rows}
    assert found["broken", None].status.startswith("ValueError: no cross-reference")
    assert [(found["short", k].page_no, found["short", k].stem, found["short", k].width, found["short", k].height) for k in range(3)] == [(k + 1, f"page_0000{k + 1}", round(w / 2), round(h / 2)) for k, (w, h) in enumerate(sizes(3, 2))]
    page = found["long", 499]
    assert bytes(page.content)[16:24] == page.width.to_bytes(4, "big") + page.height.to_bytes(4, "big")
    assert pdf_pages(spark, f"file://{folder}/long.pdf", "3, 5-6, 900").select("page_no").orderBy("page_no").toPandas()["page_no"].tolist() == [3, 5, 6]
    assert pdf_pages(spark, f"{folder}/sub/short.PDF", "77").count() == 3


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_wanted_pages_get_tasks(pushing, folder):
    pages = lambda selection=None: pdf_pages(pushing, folder, selection, pages_per_task=1, pushdown=True)
    three = pages().where(F.col("page_idx").isin(3, 100, 499) & (F.col("doc_id") == "long"))
    assert three.rdd.getNumPartitions() == 3
    assert sorted(r.page_no for r in three.collect()) == [4, 101, 500]
    ranged = pages().where("page_no > 498 AND page_no <= 600")
    assert ranged.rdd.getNumPartitions() == 2 and sorted(r.page_no for r in ranged.collect()) == [499, 500]
    assert pages().where("stem = 'page_00002' AND width > 0").count() == 2
    assert pages("1, 2, 400").where("doc_id = 'long'").rdd.getNumPartitions() == 3
    assert sorted((r.doc_id, r.page_idx) for r in pages().where("page_idx >= 498 OR page_idx IS NULL").collect() if r.page_idx) == [("long", 498), ("long", 499)]
    assert pages().where("page_idx IS NULL").count() == 1


def test_a_page_that_cannot_be_drawn_is_a_row(spark, folder):
    rows = pdf_pages(spark, f"{folder}/sub/short.PDF", renderer="docflow.sources.pdf_write:pdf").collect()  # a function of other arguments
    assert len(rows) == 3 and all(r.content is None and r.status.startswith("TypeError") for r in rows)
