"""Joining wrapped lines, and pages, of recognised text: windows over neighbours, then ordered concatenation.

Whether a line joins the one before depends on these two alone, so both operators are gaps and islands over ``lag``;
each shuffles once, on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions.text import SENSITIVE, drop_hyphens, ends_sentence, first_char, in_order, is_alpha, is_cjk, is_hyphen, is_lower, last_char, strip

PAGE_BREAK = "\n\n\\newpage\n\n"


def classify_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no, line, s (stripped), kind: F fence, C code, B blank, S sensitive, T text. Null texts count as empty."""
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line")).withColumn("s", strip(F.col("line")))
    fence = F.col("s").startswith("```")
    before = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1
    kind = F.when(fence, "F").when(inside, "C").when(F.col("s") == "", "B").when(F.col("s").rlike(SENSITIVE), "S").otherwise("T")
    return lines.withColumn("kind", kind)


def joint(p: Column, c: Column, keeps: Column) -> Column:
    """How what ends in ``p`` goes on with what begins with ``c``: H hyphenated, E with a space, J directly, null not.
    ``keeps``: whether ``p`` lets a lower-case letter follow."""
    return F.when(is_hyphen(p), "H").when(keeps & is_lower(c), "E").when(is_cjk(p) & is_cjk(c), "J")


def reflow(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text: wrapped lines joined. Keys must name a row; fenced code, blank and sensitive lines stay as they are."""
    by = W.partitionBy(*keys).orderBy("line_no")
    p = last_char(F.lag("s").over(by))
    how = F.when((F.col("kind") == "T") & (F.lag("kind").over(by) == "T"), joint(p, first_char(F.col("s")), ~ends_sentence(p)))
    lines = classify_lines(df, keys, text).withColumn("how", how).withColumn("after", F.lead("how").over(by))
    part = F.when(F.col("how").isNull(), F.col("line")).otherwise(F.col("s"))
    part = F.when(F.col("after") == "H", drop_hyphens(part)).otherwise(part)
    lead = F.when(F.col("how") == "E", " ").when(F.col("how").isNotNull() | (F.col("line_no") == 0), "").otherwise("\n")
    return lines.groupBy(*keys).agg(in_order("line_no", F.concat(lead, part), "").alias("text"))


def stitch(df: DataFrame, doc: str = "doc_id", page: str = "page_idx", text: str = "text") -> DataFrame:
    """doc, text: the non-blank pages of each document joined across their breaks; documents of blank pages get ''."""
    pages = df.select(doc, page, F.coalesce(text, F.lit("")).alias("raw")).withColumn("s", strip(F.col("raw")))
    by = W.partitionBy(doc).orderBy(page)
    full = pages.withColumn("first", F.row_number().over(by) == 1).where((F.col("s") != "") | F.col("first"))
    filled = full.where("s <> ''")
    p = last_char(F.lag("s").over(by))
    met = filled.withColumn("alone", F.lag("s").over(by).isNull()).withColumn("how", F.when(~F.col("alone"), joint(p, first_char(F.col("s")), is_alpha(p) | (p == ","))))
    met = met.withColumn("after", F.lead("how").over(by))
    # a first page after blank ones is stripped
    part = F.when(F.col("alone"), F.when(F.col("first"), F.col("raw")).otherwise(F.col("s"))).when(F.col("how").isNull(), F.concat(F.lit("\n\n"), "raw")).when(F.col("how") == "E", F.concat(F.lit(" "), "s")).otherwise(F.col("s"))
    part = F.when(F.col("after") == "H", drop_hyphens(part)).otherwise(part)
    joined = met.groupBy(doc).agg(in_order(page, part, "").alias("text"))
    blank = full.groupBy(doc).agg(F.max("s").alias("s")).where("s = ''").select(doc, F.lit("").alias("text"))
    return joined.unionByName(blank)


def merge_pages(df: DataFrame, mode: str = "paginated", doc: str = "doc_id", page: str = "page_idx", text: str = "text") -> DataFrame:
    """doc, text: the pages with page breaks between them (paginated: each stripped; cached: as they are), or reflowed and
    stitched (any other mode)."""
    if mode == "cached":
        return df.groupBy(doc).agg(in_order(page, F.coalesce(text, F.lit("")), PAGE_BREAK).alias("text"))
    if mode == "paginated":
        return df.groupBy(doc).agg(in_order(page, strip(F.coalesce(text, F.lit(""))), PAGE_BREAK).alias("text"))
    return stitch(reflow(df, [doc, page], text), doc, page)
