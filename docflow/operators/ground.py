"""Grounding tags: places on the page that a recogniser writes into its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.boxes import mapped

#: Both ways that a tag is written (fixed value): a name and four numbers, plain or between markers.
TAG = r"(?:<\|ref\|>)?([a-zA-Z_]+)(?:<\|/ref\|>)?(?:<\|det\|>)?(\[\[([0-9]+(?:,[\t-\r ]*[0-9]+){3})\]\])(?:<\|/det\|>)?"
#: Markers that a recogniser leaves, and the range of its coordinates (fixed values).
MARKERS = ("<|ref|>", "<|/ref|>", "<|det|>", "<|/det|>")
SCALE = 1000.0
#: Classes of tags that show a picture.
CLASSES = ("image", "table", "chart")
#: Colours of the diagnosis overlay (fixed values).
DIAGNOSIS = {"image": "red", "table": "blue", "chart": "orange", "title": "blue", "sub_title": "purple", "text": "green"}


def tag_class(tag: Column) -> Column:
    """image, table or chart, whichever the tag's name holds first in this order; null for others, captions and footnotes."""
    aside = tag.contains("caption") | tag.contains("footnote")
    return F.when(aside, None).when(tag.contains("image"), "image").when(tag.contains("table"), "table").when(tag.contains("chart"), "chart")


def _corners(numbers: Column, width: Column, height: Column) -> list[Column]:
    """x1, y1, x2, y2 in pixels, cut to the page."""
    c = F.transform(F.slice(F.regexp_extract_all(numbers, F.lit("[0-9]+"), F.lit(0)), 1, 4), lambda x: x.cast("double"))
    pixel = lambda i, size: (c[i] / F.lit(SCALE) * size).cast("int")
    low = [F.greatest(F.lit(0), pixel(i, size)) for i, size in ((0, width), (1, height))]
    return low + [F.least(size, pixel(i, size)) for i, size in ((2, width), (3, height))]


def _found(text: str) -> Column:
    """The tags of a text: name and numbers."""
    names, numbers = (F.regexp_extract_all(text, F.lit(TAG), F.lit(i)) for i in (1, 3))
    return F.arrays_zip(names.alias("name"), numbers.alias("numbers"))


def tags(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, tag, class, x1, y1, x2, y2 for each tag; corners in pixels of page_w and page_h, cut to the page."""
    each = df.select(*keys, "page_w", "page_h", F.posexplode(_found(text)).alias("pos", "t"))
    corners = _corners(F.col("t.numbers"), F.col("page_w"), F.col("page_h"))
    tag = F.lower("t.name")
    return each.select(*keys, "pos", tag.alias("tag"), tag_class(tag).alias("class"), *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))


def cleanup(text: Column) -> Column:
    """Without left-over markers and tags, and with one blank line for several."""
    for marker in MARKERS:
        text = F.replace(text, F.lit(marker), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"[a-zA-Z_]+\[\[.*?\]\]", ""), r"\n{3,}", "\n\n")


def rewrite(df: DataFrame, keys: list[str], stem: Column, text: str = "text") -> DataFrame:
    """keys, text: each tag replaced by its link, then cleaned up. The pieces between tags are those of a split. Rows stay
    where they are: a running count by class goes along with the links."""

    def told(t: Column) -> Column:
        x1, y1, x2, y2 = _corners(t["numbers"], F.col("page_w"), F.col("page_h"))
        return F.struct(F.when((x2 > x1) & (y2 > y1), tag_class(F.lower(t["name"]))).alias("class"))

    def step(state: Column, t: Column) -> Column:
        n = {c: state[c] + F.when(t["class"] == c, 1).otherwise(0) for c in CLASSES}
        nth = F.coalesce(*(F.when(t["class"] == c, n[c]) for c in CLASSES))
        link = F.concat(F.lit("\n\n!["), t["class"], F.lit("](images/"), stem, F.lit("_"), t["class"], F.lit("_"), nth.cast("string"), F.lit(".png)\n\n"))
        return F.struct(*(n[c].alias(c) for c in CLASSES), F.concat(state["links"], F.array(F.coalesce(link, F.lit("")))).alias("links"))

    start = F.struct(*(F.lit(0).alias(c) for c in CLASSES), F.array().cast("array<string>").alias("links"))
    links = F.aggregate(F.transform(_found(text), told), start, step, lambda state: state["links"])
    joined = F.zip_with(F.split(text, TAG, -1), links, lambda piece, link: F.concat(piece, F.coalesce(link, F.lit(""))))
    return df.select(*keys, cleanup(F.array_join(joined, "")).alias("text"))


def diagnosis(found: DataFrame, keys: list[str]) -> DataFrame:
    """What to draw for each tag: colour by its class, else by its name, else yellow."""
    name = F.coalesce("class", "tag")
    return found.select(*keys, "pos", "tag", mapped(name, DIAGNOSIS, "yellow").alias("color"), "x1", "y1", "x2", "y2")
