"""Inputs that exercise the document operators, derived from the tables; each as a DataFrame and as DuckDB SQL.

SQL that both engines read the same way is written once: {x} is table x, {div} whole division.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docflow.operators import pixels

LABELS = ("text", "paragraph_title", "doc_title", "Table", "figure", "image", "chart", "formula", "header", "footer", "abstract", "algorithm", "figure_title", "reference_content")


def _case(value: str, names: tuple[str, ...]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


#: Boxes of a page for each order; every label and score, overlaps and gaps of all kinds.
BOX = f"""
    SELECT CAST(l_orderkey % 97 AS STRING) AS doc_id, CAST(l_orderkey AS INT) AS page_idx,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS det_idx,
           l_quantity / 50 AS score, CAST(l_partkey % 14 AS INT) AS label_id, {_case("l_partkey % 14", LABELS)} AS label,
           CAST((l_partkey * 37) % 400 AS INT) AS x1, CAST((l_suppkey * 53 + l_linenumber * 97) % 600 AS INT) AS y1,
           CAST((l_partkey * 37) % 400 + 40 + l_partkey % 160 AS INT) AS x2,
           CAST((l_suppkey * 53 + l_linenumber * 97) % 600 + 10 + l_suppkey % 80 AS INT) AS y2, 600 AS page_w, 800 AS page_h
    FROM {{lineitem}}"""
KEPT = f"SELECT * FROM ({BOX}) WHERE score >= 0.4"
PAGES = "SELECT DISTINCT doc_id, page_idx, page_w, page_h FROM ({0})".format(KEPT)

#: Boxes of small pages, one for each customer; nothing leaves its page.
PICTURE_BOX = f"""
    SELECT CAST(o_custkey % 50 AS STRING) AS doc_id, CAST(o_custkey AS INT) AS page_idx, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS det_idx,
           {_case("o_orderkey % 14", LABELS)} AS label, CAST((o_orderkey * 37) % 180 AS INT) AS x1, CAST((o_orderkey * 53 + o_custkey) % 130 AS INT) AS y1,
           CAST((o_orderkey * 37) % 180 + 10 + o_orderkey % 50 AS INT) AS x2, CAST((o_orderkey * 53 + o_custkey) % 130 + 4 + o_orderkey % 61 AS INT) AS y2, 240 AS page_w, 200 AS page_h
    FROM {{orders}}"""

#: Recognition results in any order: some early, some twice, one block of each fourth document never.
_EVENT = """
    SELECT CAST(user_id % 10 AS STRING) AS doc_id, CAST((event_id {div} 7) % 6 AS INT) AS page_idx, CAST(event_id % 5 AS INT) AS block_idx,
           ((event_id * 7919) % 10007) * 10000000 + event_id AS seq, concat(event_type, CAST(event_id AS STRING), '```') AS content
    FROM {events}"""
BLOCK = f"""
    SELECT doc_id, page_idx, block_idx, CASE WHEN block_idx = 4 THEN 'image' ELSE 'ocr' END AS kind,
           CASE (page_idx + block_idx) % 7 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'paragraph_title' WHEN 2 THEN 'abstract' WHEN 3 THEN 'algorithm' WHEN 4 THEN 'figure_title' ELSE 'text' END AS label,
           CASE WHEN block_idx = 4 THEN concat('images/p', CAST(page_idx AS STRING), '.png') END AS image_path, CASE WHEN block_idx = 4 THEN '{{{{width=70%}}}}' END AS width_str
    FROM (SELECT DISTINCT doc_id, page_idx, block_idx FROM ({_EVENT}))"""
REGISTERED = f"SELECT DISTINCT doc_id, page_idx, CAST(2000 + page_idx % 3 AS BIGINT) * 10000000 AS seq FROM ({_EVENT})"
FILLS = f"SELECT * FROM ({_EVENT}) WHERE NOT (doc_id IN ('0', '4', '8') AND page_idx = 3 AND block_idx = 2)"

#: Of these documents the layout of one page failed. Answers count until a deadline after their page's registration.
FAILED_PAGE = "doc_id IN ('1', '5') AND page_idx = 4"
DEADLINE = 40_000_000_003


def duck(template: str) -> str:
    return template.replace("{div}", "//").replace("{{", "\0").replace("}}", "\1").translate({ord("{"): None, ord("}"): None}).replace("\0", "{").replace("\1", "}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    text = template.replace("{div}", "DIV")
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def drawn(page_idx: int, width: int, height: int) -> np.ndarray:
    """A page's picture: (3 x + 5 y + page_idx) % 250 at each place, in all channels."""
    ramp = (np.arange(3 * width + 5 * height, dtype=np.int64) + page_idx) % 250
    values = np.lib.stride_tricks.as_strided(ramp.astype(np.uint8), (height, width), (5, 3))
    out = np.empty((height, width, 3), np.uint8)
    for channel in range(3):
        out[..., channel] = values
    return out


def png_pictures(pages: DataFrame) -> DataFrame:
    """The pictures of ``pictures`` as PNG files: doc_id, page_idx, content. No pixels leave the task that draws them."""

    def draw(frames):
        for pdf in frames:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                yield part[["doc_id", "page_idx"]].assign(content=[pixels.to_png(drawn(p, w, h)) for p, w, h in zip(part["page_idx"], part["page_w"], part["page_h"], strict=True)])

    return pages.mapInPandas(draw, "doc_id string, page_idx int, content binary")


def pictures(pages: DataFrame, *carried: str) -> DataFrame:
    """Decoded pictures, as the image source gives them, of rows with doc_id, page_idx, page_w and page_h: grey, never white.
    Columns ``carried`` stay beside them."""

    def draw(frames):
        for pdf in frames:
            for k in range(0, len(pdf), 32):  # a picture is large, so a batch has few
                part = pdf.iloc[k : k + 32]
                made = [drawn(p, w, h).tobytes() for p, w, h in zip(part["page_idx"], part["page_w"], part["page_h"], strict=True)]
                yield part[["doc_id", "page_idx", *carried]].assign(width=part["page_w"], height=part["page_h"], nChannels=3, data=made)

    return pages.mapInPandas(draw, picture_schema(pages, carried))


def picture_schema(pages: DataFrame, carried: tuple[str, ...]) -> StructType:
    rows = pages.select("doc_id", "page_idx", *carried).schema
    return rows.add("width", "integer").add("height", "integer").add("nChannels", "integer").add("data", "binary")


def skewed_pictures(pages: DataFrame, *carried: str) -> DataFrame:
    """Decoded pictures, as ``pictures``, of pages with three dark lines at ``angle`` degrees on white."""
    import numpy as np

    def draw(frames):
        for pdf in frames:
            for k in range(0, len(pdf), 32):
                part = pdf.iloc[k : k + 32]
                made = []
                for w, h, angle in zip(part["page_w"], part["page_h"], part["angle"], strict=True):
                    y, x = np.arange(h)[:, None], np.arange(w)
                    t = np.radians(angle)
                    across = (y - h / 2) * np.cos(t) - (x - w / 2) * np.sin(t)
                    along = (y - h / 2) * np.sin(t) + (x - w / 2) * np.cos(t)
                    dark = (np.abs(along) < 0.42 * w) & (np.abs((across + 20) % 40 - 20) < 1.5) & (np.abs(across) < 60)
                    made.append(np.repeat(np.where(dark, 0, 255).astype(np.uint8).ravel(), 3).tobytes())
                yield part[["doc_id", "page_idx", *carried]].assign(width=part["page_w"], height=part["page_h"], nChannels=3, data=made)

    return pages.mapInPandas(draw, picture_schema(pages, carried))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a PDF file for each supplier, of up to 40 pages of three sizes; every other file is packed."""
    from docflow.sources.pdf_write import packed_pdf, pdf

    def make(frames):
        for pdf_ in frames:
            sizes = [[(600 + 12 * ((s + k) % 3), 800 + 24 * (k % 2)) for k in range(s % 40 + 1)] for s in pdf_["s_suppkey"]]
            yield pdf_.assign(path=[f"{s % 10}/{s}.pdf" for s in pdf_["s_suppkey"]], content=[(packed_pdf if s % 2 else pdf)(x) for s, x in zip(pdf_["s_suppkey"], sizes, strict=True)])[["path", "content"]]

    return table(spark, sf_dir, "supplier").select("s_suppkey").mapInPandas(make, "path string, content binary")


#: What is added to each text, by doc_id % 10: branches that the texts lack.
TAILS = ("```\na-\nb\n```", "| a | b |\nc", "1. x\ny", "- x\ny", "Fig. 3 x\ny", "漢字\n漢字", "foo  \nbar", "\n---\ntext", "＃１ ＡＢｃ！\n<table>\nx\n$$\ny", "> q\nr\n* s\n# t\nu")
LINES_SQL = (
    r"SELECT doc_id, concat(regexp_replace(text, '(\p{L}{3})(\p{L}{3}) ', '\1-' || chr(10) || '\2 ', 'g'), chr(10), CASE doc_id % 10 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS))
    + " END) AS text FROM documents"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wrapped lines."""
    tail = F.lit(None).cast("string")
    for i, t in enumerate(TAILS):
        tail = F.when(F.col("doc_id") % 10 == i, t).otherwise(tail)
    wrapped = F.regexp_replace("text", r"(\p{L}{3})(\p{L}{3}) ", "$1-\n$2 ")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(wrapped, F.lit("\n"), tail).alias("text"))


#: Turns as pages: hyphens, commas, ideographs and blank pages at the breaks, lower-case beginnings.
PAGE = """
    SELECT conv_id AS doc_id, CAST(turn AS INT) AS page_idx,
           CASE turn % 5 WHEN 3 THEN ' ' ELSE concat(CASE WHEN turn % 3 = 0 THEN lower(text) WHEN conv_id % 4 = 1 THEN concat('漢', text) ELSE text END,
                CASE turn % 5 WHEN 0 THEN '-' WHEN 1 THEN ',' WHEN 2 THEN '漢' ELSE '' END) END AS text
    FROM (SELECT conv_id, turn, max(text) AS text FROM {conversations} GROUP BY conv_id, turn)"""

#: Tags in text: both spellings, captions and footnotes, and rectangles without area.
GROUND = """
    SELECT item_id, 640 AS page_w, 480 AS page_h,
           concat(text, ' table[[', CAST(item_id * 7 % 900 AS STRING), ', ', CAST(item_id * 11 % 800 AS STRING), ', ', CAST(item_id * 7 % 900 + 90 AS STRING), ', ', CAST(item_id * 11 % 800 + item_id % 5 * 40 AS STRING), ']] mid ',
                  '<|ref|>image<|/ref|><|det|>[[', CAST(item_id % 100 AS STRING), ',5,', CAST(item_id % 100 + 300 AS STRING), ',1200]]<|/det|> image_caption[[1, 2, 30, 40]] chart_footnote[[1, 2, 30, 40]] ',
                  'Chart[[0, 0, 500, 500]] table[[10, 10, 200, 200]] title[[1, 1, 9, 9]] image[[5, 5, 4, 4]] rest[[1, 2]] <|det|> end') AS text
    FROM {benchmark}"""
