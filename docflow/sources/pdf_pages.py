"""Pages of PDF files as rows: a data source whose partitions are ranges of wanted pages.

The driver reads the page counts (files in parallel, by random access); of very many files it counts the large ones only,
and small ones go to tasks in groups, so that tasks and driver don't grow with each file. Filters on the page and on the file reach the
source, so that files and pages that nobody wants get no task. Drawing a page is left to a renderer, named as
``module:function``, which gets the file's path, the page's number from 0 and the resolution, and returns a PNG file.
"""

from __future__ import annotations

import importlib
import operator
import posixpath
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from docflow.sources.file_sink import file_system
from docflow.sources.pdf_index import PdfIndex
from docflow.sources.work import register

SCHEMA = "path string, doc_id string, page_idx int, page_no int, stem string, width int, height int, content binary, status string"
#: Points an inch, files opened at a time, and pages of a task.
POINTS, OPEN, PAGES = 72, 32, 16
#: Files whose pages the driver counts; of more, those of at most SMALL bytes are counted by tasks, TOGETHER in each.
FEW, SMALL, TOGETHER = 500, 256 << 10, 64


@dataclass
class Pages(InputPartition):
    """Wanted pages of a file, rising. ``status``: what went wrong with the whole file, in one row without a page."""

    file: str
    numbers: tuple[int, ...]
    status: str | None = None


@dataclass
class Whole(InputPartition):
    """Small files, whose pages are counted where they are read."""

    files: tuple[str, ...]


def stem_of(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def page_stem(page_idx: int) -> str:
    return f"page_{page_idx + 1:05d}"


#: What a file's or a page's column is compared by.
TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: operator.eq, In: lambda a, b: a in b, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
}
FILE = {"path": lambda f: f, "doc_id": stem_of}
PAGE = {"page_idx": lambda k: k, "page_no": lambda k: k + 1, "stem": page_stem}


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.dpi = float(options.get("dpi", 300))
        self.step = int(options.get("pagesPerTask", PAGES))
        self.renderer = options.get("renderer")
        chosen = options.get("pages", "")
        self.chosen = {int(p) for p in chosen.split(",")} if chosen else None
        self.file_tests: list[Callable[[str], bool]] = []
        self.page_tests: list[Callable[[int], bool]] = []

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.folder)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        sizes = {f.path: f.size for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".pdf") and all(t(f.path) for t in self.file_tests)}
        names = sorted(sizes)
        small = [n for n in names if sizes[n] <= SMALL] if len(names) > FEW else []
        large = [n for n in names if sizes[n] > SMALL] if small else names
        with ThreadPoolExecutor(OPEN) as pool:
            counted = [p for parts in pool.map(self.ranges, large) for p in parts]
        return counted + [Whole(tuple(small[k : k + TOGETHER])) for k in range(0, len(small), TOGETHER)]

    def ranges(self, name: str) -> list[Pages]:
        try:
            fs, _ = file_system(self.folder)
            with fs.open_input_file(name) as file:
                n = len(PdfIndex(file))
        except Exception as e:
            return [] if self.page_tests else [Pages(name, (), f"{type(e).__name__}: {e}")]
        # of a selection, pages that there are; all, if there are none
        there = [k for k in range(n) if self.chosen is None or k in self.chosen] or list(range(n))
        wanted = [k for k in there if all(t(k) for t in self.page_tests)]
        return [Pages(name, tuple(wanted[k : k + self.step])) for k in range(0, len(wanted), self.step)]

    def read(self, part: Pages | Whole) -> Iterator[tuple]:
        if isinstance(part, Whole):
            for name in part.files:
                for own in self.ranges(name):
                    yield from self.read(own)
            return
        if part.status:
            yield part.file, stem_of(part.file), None, None, None, None, None, None, part.status
            return
        draw = None
        if self.renderer:
            module, _, name = self.renderer.partition(":")
            draw = getattr(importlib.import_module(module), name)
        fs, _ = file_system(self.folder)
        with fs.open_input_file(part.file) as file:
            for k, width, height in PdfIndex(file).pages(list(part.numbers)):
                size = tuple(max(1, round(x * self.dpi / POINTS)) for x in (width, height))
                content = status = None
                try:
                    content = draw(part.file, k, self.dpi) if draw else None
                except Exception as e:
                    status = f"{type(e).__name__}: {e}"
                yield part.file, stem_of(part.file), k, k + 1, page_stem(k), *size, content, status


class PushingReader(PdfReader):
    """With filters; Spark takes a reader that has them only where they are enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            test = TESTS.get(type(f))
            if isinstance(f, IsNotNull) and column in FILE:
                continue  # every row has a file
            if test and column in FILE:
                self.file_tests.append(lambda x, f=f, test=test, of=FILE[column]: test(of(x), f.value))
            elif test and column in PAGE:
                self.page_tests.append(lambda k, f=f, test=test, of=PAGE[column]: test(of(k), f.value))
            else:
                yield f


class PdfPages(DataSource):
    """``pdf_pages``: options path (a file or a folder), pages (numbers from 0), dpi, renderer, pagesPerTask, and pushdown
    (needs spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else PdfReader)(self.options)


def pdf_pages(spark: SparkSession, path: str, selection: str | None = None, dpi: float = 300, renderer: str | None = None, pages_per_task: int = PAGES, pushdown: bool = False) -> DataFrame:
    """Rows of SCHEMA for the pages of a PDF file or of those in a folder; ``selection`` as in ``1, 3-5``.

    A file that can't be read is a row with a status and no page, a page that can't be drawn has a status. With
    ``pushdown`` filters on path, doc_id, page_idx, page_no and stem reach the source; that needs
    spark.sql.python.filterPushdown.enabled, and a new call for each query: Spark keeps a relation's filters with it.
    """
    from docflow.sources.files import selected_pages

    register(spark, PdfPages)
    read = spark.read.format("pdf_pages").option("path", path).option("dpi", dpi).option("pagesPerTask", pages_per_task)
    read = read.option("pushdown", str(pushdown).lower())
    if selection and (chosen := spark.range(1).select(selected_pages(F.lit(selection)).alias("p")).first()["p"]):
        read = read.option("pages", ",".join(map(str, chosen)))
    return (read.option("renderer", renderer) if renderer else read).load()


def blank_page(path: str, page_idx: int, dpi: float) -> bytes:
    """A renderer for tests and dry runs: a white page of the right size."""
    import numpy as np

    from docflow.operators.pixels import to_png

    with file_system(path)[0].open_input_file(file_system(path)[1]) as file:
        _, width, height = next(PdfIndex(file).pages([page_idx]))
    return to_png(np.full((max(1, round(height * dpi / POINTS)), max(1, round(width * dpi / POINTS)), 3), 255, np.uint8))
