"""Assembly of out-of-order recognition results, in batch.

A log has events (doc_id, page_idx, seq, kind, block_idx, content): a page is registered once, its ocr blocks are
filled; seq orders a document's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_idx"]


def first_fills(blocks: DataFrame, registered: DataFrame, fills: DataFrame, deadline: int | None = None) -> DataFrame:
    """doc_id, page_idx, block_idx, content, seq: the first fill of each ocr block after its page was registered, and not
    more than ``deadline`` after."""
    known = blocks.where("kind = 'ocr'").select(*PAGE, "block_idx").join(registered.select(*PAGE, F.col("seq").alias("_from")), PAGE)
    met = fills.join(known, [*PAGE, "block_idx"]).where(F.col("seq") > F.col("_from"))
    if deadline is not None:
        met = met.where(F.col("seq") <= F.col("_from") + deadline)
    return met.groupBy(*PAGE, "block_idx").agg(F.min_by("content", "seq").alias("content"), F.min("seq").alias("seq"))


def late_blocks(blocks: DataFrame, registered: DataFrame, accepted: DataFrame, deadline: int, now: Column, text: str) -> DataFrame:
    """doc_id, page_idx, block_idx, content, seq of ocr blocks without an accepted fill at their deadline, if that is
    before ``now``: the failure text, at the deadline."""
    open_ = blocks.where("kind = 'ocr'").select(*PAGE, "block_idx").join(accepted.select(*PAGE, "block_idx"), [*PAGE, "block_idx"], "left_anti")
    due = registered.select(*PAGE, (F.col("seq") + deadline).alias("seq")).where(F.col("seq") < now)
    return open_.join(due, PAGE).select(*PAGE, "block_idx", F.lit(text).alias("content"), "seq")


def flush_order(blocks: DataFrame, registered: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, page_idx, ready_seq, flush_seq of the pages that are written: in order, up to the first never ready.

    A page is ready when all its ocr blocks are filled; pages count from 0 without gaps.
    """
    pending = registered.select(*PAGE, "seq").join(blocks.where("kind = 'ocr'").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")), PAGE, "left")
    got = accepted.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("got"), F.max("seq").alias("last"))
    full = F.coalesce("n", F.lit(0)) == F.coalesce("got", F.lit(0))
    ready = pending.join(got, PAGE, "left").select(*PAGE, F.when(full, F.greatest("seq", F.coalesce("last", "seq"))).alias("ready_seq"))
    sofar = W.partitionBy("doc_id").orderBy("page_idx").rowsBetween(W.unboundedPreceding, 0)
    run = ready.withColumn("ok", (F.count(F.lit(1)).over(sofar) == F.count("ready_seq").over(sofar)) & (F.count(F.lit(1)).over(sofar) == F.col("page_idx") + 1))
    return run.withColumn("flush_seq", F.max("ready_seq").over(sofar)).where("ok").select(*PAGE, "ready_seq", "flush_seq")
