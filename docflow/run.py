"""From files to documents: pages are read, turned straight, laid out, recognised and written, or rendered again from the
nested form of an earlier run.

    python -m docflow.run INPUT [OUTPUT] [--force] [--ocr-table] [--keep-header-footer] [--pages 1,3-5]
                          --layout module:Class --recogniser module:Class|http://...
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import boxes, crops, infer, lines, order, overlay, reflow, render
from docflow.operators.progress import Progress
from docflow.schema import MIDDLE
from docflow.sources import file_sink, files
from docflow.sources.pdf_pages import pdf_pages
from docflow.sources.work import work_folder

PAGE = ["doc_id", "page_idx"]


@dataclass(frozen=True)
class Options:
    """What a run does. ``labels``: names of the layout model's ids. ``renderer`` draws pages of PDF files."""

    labels: dict[int, str] = field(default_factory=dict)
    force: bool = False
    ocr_table: bool = False
    keep_header_footer: bool = False
    pages: str | None = None
    dpi: float = 300
    renderer: str | None = None
    policy: infer.Policy = infer.BLOCKS
    model: str = "recogniser"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table: later steps don't work them out again."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def source_pages(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """doc_id, page_idx, stem, content, status: the pages of PDF files and, each a page of its own, pictures, of a file or a
    folder. A file's stem names its document."""
    fs, root = file_sink.file_system(path)
    single = fs.get_file_info(root).is_file
    pdf = pdf_pages(spark, path, options.pages, options.dpi, options.renderer).select("doc_id", F.coalesce("page_idx", F.lit(0)).alias("page_idx"), F.coalesce("stem", F.lit("page_00001")).alias("stem"), "content", "status")
    if single and path.lower().endswith(".pdf"):
        return pdf
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    read = spark.read.format("binaryFile").load(path).select("path", "content") if single else files.image_files(spark, path)
    pictures = read.select(boxes.page_stem(name).alias("doc_id"), F.lit(0).alias("page_idx"), boxes.page_stem(name).alias("stem"), "content", F.lit(None).cast("string").alias("status"))
    return pictures if single else pdf.unionByName(pictures)


def decoded(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, width, height, nChannels, data of pages whose content is a picture. They go through files, as the
    image source reads nothing else."""
    folder = work_folder(spark, "pages")
    place = F.concat(F.sha2("doc_id", 256), F.lit("/"), F.col("page_idx").cast("string"))
    file_sink.write_files(pages.where("content IS NOT NULL").select(place.alias("path"), "content"), folder)
    read = files.decoded_images(spark, folder, deep=True).withColumn("_place", F.substring_index("origin", "/", -2))
    return read.join(pages.select(*PAGE, place.alias("_place")), "_place").select(*PAGE, "width", "height", "nChannels", "data")


def cached_documents(spark: SparkSession, out: str) -> DataFrame:
    """doc_id and json of earlier runs; files that can't be read as the nested form don't count."""
    fs, root = file_sink.file_system(out)
    if not fs.get_file_info(root).type.value == 3:  # no folder yet
        return spark.createDataFrame([], "doc_id string, json string")
    read = spark.read.option("pathGlobFilter", "*_middle.json").option("recursiveFileLookup", "true").text(out, wholetext=True)
    found = read.select(F.regexp_replace("_metadata.file_name", r"_middle\.json\z", "").alias("doc_id"), F.col("value").alias("json"))
    return found.where(F.from_json("json", MIDDLE)["pdf_info"].isNotNull())


def laid_out(pages: DataFrame, layout: Callable[[], infer.LayoutModel], options: Options, progress: Progress) -> tuple[DataFrame, DataFrame]:
    """All boxes of decoded pages, with page_w and page_h; and detections, with what went wrong."""
    pictures = pages.select(*PAGE, crops.png("data", "width", "height", "nChannels").alias("content"))
    seen = progress.observed(infer.detect(pictures, layout), "layout")
    with progress.timed("layout"):
        found = kept(seen, "layout")
    sizes = pages.select(*PAGE, F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    return kept(boxes.detections(found, options.labels or {0: "text"}).join(sizes, PAGE), "boxes"), found


def process(spark: SparkSession, path: str, out: str, layout: Callable[[], infer.LayoutModel], recogniser: Callable[[], infer.TextRecognizer], options: Options = Options()) -> Progress:  # noqa: B008
    """Writes below ``out`` for each document: final_output.md, <doc>_middle.json, images/ and diagnostics/. Documents with
    the nested form of an earlier run are rendered from it, without any model, unless ``options.force``.

    Pages that can't be read, drawn, decoded or laid out become pages with a failure text, blocks that can't be recognised
    get one; a run never ends for them.
    """
    progress = Progress()
    pages = kept(source_pages(spark, path, options), "sources")
    known = spark.createDataFrame([], "doc_id string, json string") if options.force else cached_documents(spark, out)
    hits, misses = render.split_cached(pages.select("doc_id").distinct(), known)
    again = cached_rows(known.join(hits, "doc_id", "left_semi"))
    new = new_rows(spark, pages.join(misses, "doc_id", "left_semi"), layout, recogniser, options, progress)
    written = progress.observed(again.unionByName(new).withColumn("status", F.lit(None).cast("string")), "files")
    with progress.timed("files"):
        file_sink.write_files(written, out)
    return progress


def cached_rows(known: DataFrame) -> DataFrame:
    pages, blocks = render.from_middle(known)
    text = render.render_pages(pages, blocks, "cached").select(*PAGE, F.col("markdown").alias("text"))
    return as_binary(file_sink.document_rows(reflow.merge_pages(text, "cached")))


def new_rows(spark: SparkSession, pages: DataFrame, layout: Callable[[], infer.LayoutModel], recogniser: Callable[[], infer.TextRecognizer], options: Options, progress: Progress) -> DataFrame:
    """path and content of all files of documents that are worked out anew."""
    raw = kept(decoded(spark, pages), "decoded")
    straight = kept(lines.deskewed(raw, kept(lines.page_skew(raw), "skew")), "straight")
    found, status = laid_out(straight, layout, options, progress)
    stems = pages.select(*PAGE, "stem")
    placed = boxes.drop_headers(order.with_reading_order(found), options.keep_header_footer)
    routed = boxes.route(placed, table_as_image=not options.ocr_table).join(stems, PAGE)
    named = kept(boxes.name_crops(routed, F.col("stem")), "blocks")
    made = kept(crops.crop_images(straight, named, found), "crops")
    tasks = made.where("kind = 'ocr'").join(named.select(*PAGE, "det_idx", "block_idx", "label"), [*PAGE, "det_idx"])
    asked = progress.observed(infer.recognise(tasks, recogniser, options.model, options.policy), "recognition")
    with progress.timed("recognition"):
        fills = kept(asked, "fills")
    # what went wrong before the layout, in it, and nothing: one structure for all pages
    wrong = pages.join(status.select(*PAGE, F.col("status").alias("_layout")), PAGE, "left").join(straight.select(*PAGE, F.lit(True).alias("_seen")), PAGE, "left")
    message = F.coalesce("status", "_layout", F.when(F.col("_seen").isNull(), "ValueError: not a picture"))
    errors = infer.error_pages(wrong.select(*PAGE, message.alias("status")))
    shown = named.select(*PAGE, "block_idx", "kind", "label", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.lit(None).cast("string").alias("content"), "image_path", "width_str")
    blocks = kept(render.fill(shown, fills).select(*shown.columns).unionByName(errors), "filled")
    sizes = straight.select(*PAGE, F.col("width").alias("page_w"), F.col("height").alias("page_h")).join(errors.select(*PAGE), PAGE, "left_anti")
    sizes = sizes.unionByName(errors.select(*PAGE, F.lit(100).alias("page_w"), F.lit(100).alias("page_h")))
    documents = file_sink.document_rows(render.render_documents(render.render_pages(sizes, blocks)))
    middle = file_sink.middle_rows(render.to_middle(sizes, blocks))
    drawn = overlay.overlay_images(straight, boxes.overlay(found), "det_idx").join(stems, PAGE)
    pictures = crops.crop_rows(made, named.select(*PAGE, "det_idx", "image_path"))
    return as_binary(documents).unionByName(as_binary(middle)).unionByName(pictures).unionByName(overlay.overlay_rows(drawn, F.col("stem")))


def as_binary(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.encode("content", "UTF-8").alias("content"))


def named_object(name: str) -> object:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docflow.run", description="Files to documents.")
    parser.add_argument("input")
    parser.add_argument("output", nargs="?")
    for flag in ("force", "ocr-table", "keep-header-footer"):
        parser.add_argument(f"--{flag}", action="store_true")
    parser.add_argument("--pages")
    parser.add_argument("--dpi", type=float, default=300)
    parser.add_argument("--renderer", help="module:function that draws a page of a PDF file")
    parser.add_argument("--layout", required=True, help="module:Class of the layout model; its attribute LABELS names its ids")
    parser.add_argument("--recogniser", help="module:Class, or the address of a server; default: VLLM_API_URL")
    a = parser.parse_args(arguments)
    settings = files.Settings.from_env()
    layout, server = named_object(a.layout), a.recogniser or settings.api_url
    recogniser = partial(infer.HttpRecognizer, server) if "://" in server else named_object(server)
    spark = SparkSession.builder.appName("docflow").getOrCreate()
    options = Options(getattr(layout, "LABELS", {}), a.force, a.ocr_table, a.keep_header_footer, a.pages, a.dpi, a.renderer, model=settings.model_name)
    print(process(spark, a.input, a.output or "ocr_output", layout, recogniser, options).log())


if __name__ == "__main__":
    main()
