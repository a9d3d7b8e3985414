"""Detections to boxes, and boxes to blocks: filters, labels, routing, counters, names and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_SCORE = 0.4
#: Prompt and token budget by label (fixed values); others get those of text.
PROMPTS = {"table": ("Table Recognition:", 4096), "formula": ("Formula Recognition:", 256)}
TEXT_PROMPT = ("Text Recognition:", 1024)
#: Prompts of whole pages by mode, and their budget (fixed values).
PAGE_PROMPTS = {"text": "Text Recognition:", "table": "Table Recognition:", "formula": "Formula Recognition:"}
PAGE_TOKENS = 1536
PICTURES = ("figure", "image", "chart")
#: Colours of the overlay by label (fixed values).
OVERLAY = {"text": "green", "table": "blue", "formula": "red", "figure": "purple", "image": "purple", "chart": "purple"}
PAGE = ["doc_id", "page_idx"]


def mapped(key: Column, names: dict[str, str], default: Column | str | None) -> Column:
    """A literal map's value, or the default; safe for keys it lacks."""
    if not names:
        return F.lit(default) if isinstance(default, str) else default
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default) if isinstance(default, str) else default)


def detections(df: DataFrame, id2label: dict[int, str], keys: list[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """keys, det_idx, score, label, x1, y1, x2, y2 of the detections in columns scores, labels and boxes.

    Rows that lack one of the three have none. A score under ``least_score`` goes, NaN stays; det_idx counts what
    stays. Coordinates are cut towards zero. Unknown labels are Label_<id>.
    """
    keys = PAGE if keys is None else keys
    whole = df.where("scores IS NOT NULL AND labels IS NOT NULL AND boxes IS NOT NULL")
    each = whole.select(*keys, F.posexplode(F.arrays_zip("scores", "labels", "boxes")).alias("pos", "d")).where(F.col("d.scores") >= least_score)
    nth = (F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1).cast("int")
    names = F.create_map(*(F.lit(x) for kv in id2label.items() for x in kv))
    label = F.coalesce(F.try_element_at(names, F.col("d.labels")), F.concat(F.lit("Label_"), F.col("d.labels")))
    corners = [F.col("d.boxes")[i].cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return each.select(*keys, nth.alias("det_idx"), F.col("d.scores").alias("score"), label.alias("label"), *corners)


def drop_headers(df: DataFrame, keep: bool = False) -> DataFrame:
    """Without footers, and without headers on pages that have no table; block numbers keep their gaps."""
    if keep:
        return df
    label = F.lower("label")
    has_table = F.max((label == "table").cast("int")).over(W.partitionBy(*PAGE)) == 1
    return df.withColumn("_table", has_table).where((label != "footer") & ((label != "header") | F.col("_table"))).drop("_table")


def route(df: DataFrame, table_as_image: bool = True, formula_as_image: bool = False) -> DataFrame:
    """Adds kind (image or ocr) and tag (fig, table, formula; null for ocr)."""
    label = F.lower("label")
    tag = F.when(label.isin(*PICTURES), "fig").when((label == "table") & F.lit(table_as_image), "table").when((label == "formula") & F.lit(formula_as_image), "formula")
    return df.withColumn("tag", tag).withColumn("kind", F.when(F.col("tag").isNotNull(), "image").otherwise("ocr"))


def width_bucket() -> Column:
    """How wide a picture is shown, by its share of the page's width; formulas get ''."""
    share = (F.col("x2") - F.col("x1")).cast("double") / F.col("page_w")
    return F.when(F.col("tag").isin("fig", "table"), F.when(share >= 0.65, "{width=100%}").when(share >= 0.35, "{width=70%}").otherwise("{width=45%}")).when(F.col("tag").isNotNull(), "")


def name_crops(df: DataFrame, stem: Column) -> DataFrame:
    """Adds n (of its tag on the page, in reading order), image_path and width_str; null for ocr blocks. Filter first."""
    nth = F.row_number().over(W.partitionBy(*PAGE, "tag").orderBy("block_idx"))
    named = df.withColumn("n", F.when(F.col("tag").isNotNull(), nth))
    path = F.when(F.col("tag").isNotNull(), F.concat(F.lit("images/"), stem, F.lit("_"), "tag", F.lit("_"), "n", F.lit(".png")))
    return named.withColumn("image_path", path).withColumn("width_str", width_bucket())


def prompts(df: DataFrame) -> DataFrame:
    """Adds prompt, max_tokens and temperature of the request for each block."""
    label = F.lower("label")
    prompt, tokens = F.lit(TEXT_PROMPT[0]), F.lit(TEXT_PROMPT[1])
    for name, (p, n) in PROMPTS.items():
        prompt, tokens = F.when(label == name, p).otherwise(prompt), F.when(label == name, n).otherwise(tokens)
    return df.withColumns({"prompt": prompt, "max_tokens": tokens, "temperature": F.lit(0.0)})


def overlay(df: DataFrame) -> DataFrame:
    """What to draw for each kept box: its rectangle, colour, and label with its anchor."""
    return df.select(*PAGE, "det_idx", "x1", "y1", "x2", "y2", mapped(F.lower("label"), OVERLAY, "yellow").alias("color"), "label", F.col("x1").alias("text_x"), F.greatest(F.lit(0), F.col("y1") - 12).alias("text_y"))


def page_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*\z", "")
