"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Digests are written once, with a number for each row. Counted by digest they tell which texts are hot: those with more
than ``HOT_ROWS`` rows and more than ``HOT_SHARE`` of all rows, of which there are 1 / HOT_SHARE at most. A hot digest
gets as many salts as it takes for each to stand for an even share of its rows. Then three stages combine texts, each
by the digest *and* the full normalised text, so that contents are compared whenever rows are combined:

1. local: the map-side half of the first aggregation leaves one row per text and input partition;
2. salted: those rows meet by (digest, salt, text), where the salt comes from the input partition;
3. global: the winners of all salts meet by digest. Where there were several salts, texts travel along and are compared
   again; a digest of one salt has met all its texts already, so more than one of them means that contents differ.

So each distinct text of an input partition crosses the network once, and only hot texts twice. Rows get their group's
winner by a join on (digest, salt) without texts. Two texts of one SHA-256 digest would stop the job, so the join on the
digest can't confuse contents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import finished, fresh, materialise

#: Each run of these characters counts as one space.
SPACES = r"[\x20\x09-\x0D]+"
#: A digest is hot with more rows than this and than this share of all.
HOT_ROWS, HOT_SHARE = 256, 1e-5


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


@dataclass(frozen=True)
class Combined:
    """Tables of one run: each row's digest (row, doc_id, sha), the hot digests (sha, salts), and the texts' winners
    (sha, keep_id, group_size, keep_row, same: rows that share the winner's id and text)."""

    rows: DataFrame
    hot: DataFrame
    winners: DataFrame


def salted(frame: DataFrame, hot: DataFrame, by: Column) -> DataFrame:
    """Adds salt (0 but for rows of hot digests) and salts. ``hot`` has 1 / HOT_SHARE rows at most."""
    return frame.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.coalesce(F.pmod(by, "salts"), F.lit(0)).cast("int"))


def combined(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS) -> Combined:
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("sha", digest(F.col("norm")))
    rows = materialise(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha"), "dedup-rows")
    least = max(hot_rows, HOT_SHARE * rows.count())
    counts = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(counts.where(F.col("n") > least).select("sha", F.ceil(F.col("n") / least).alias("salts")), "dedup-hot")

    dealt = salted(texts, hot, F.spark_partition_id())
    met = dealt.groupBy("sha", "salt", "salts", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = (
        met.select("sha", F.when(F.col("salts").isNotNull(), F.col("norm")).alias("content"), "keep_id", "n")
        .repartition("sha")
        .groupBy("sha", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.when(F.col("content").isNull(), F.count(F.lit(1))).otherwise(1).alias("contents"))
        .groupBy("sha")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.sum("contents").alias("contents"))
    )
    size = F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).otherwise(F.col("n"))
    first = rows.groupBy("sha", "doc_id").agg(F.min("row").alias("keep_row"), F.count(F.lit(1)).alias("same")).withColumnRenamed("sha", "own_sha")
    found = winners.select("sha", "keep_id", size.alias("group_size")).join(first, (F.col("sha") == F.col("own_sha")) & F.col("keep_id").eqNullSafe(F.col("doc_id")))
    return Combined(rows, hot, found.select("sha", "keep_id", "group_size", "keep_row", "same"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    * Null texts count as empty, and empty texts form one group. Very long texts are compared whole.
    * keep_id is the least id of the group; null ids come last (keep_id is null only if all ids of a group are).
    * Of repeated rows (same id and text) just one is kept; which one makes no difference to this result.
    * No rows in, no rows out. Other columns of ``df`` are not read, whatever their names.
    """
    c = combined(df, id_col, text_col, hot_rows)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)).cast("int") - 1)).alias("salt")
    winners = c.winners.join(F.broadcast(c.hot), "sha", "left").select("sha", "keep_id", "group_size", "keep_row", every)
    found = salted(c.rows, c.hot, F.col("row")).drop("salts").join(winners, ["sha", "salt"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``df`` that exact_dedup keeps, with all their columns, whatever the others' names.

    Nulls, empty texts, ties and empty tables are as there; of rows with one id and text any one stays. Whole rows are
    joined once with the winners' ids and digests; where rows are repeated, what the join leaves is a table, and the
    repeated rows alone are combined, before they are shuffled.
    """
    spark, (sha, key, own, same) = df.sparkSession, fresh(df, "sha", "keep_id", "keep_sha", "same")
    named = lambda: combined(df, id_col, text_col, hot_rows).winners.select(F.col("keep_id").alias(key), F.col("sha").alias(own), F.col("same").alias(same))
    winners = finished(spark, named, "dedup-winners")
    keyed = df.withColumn(sha, digest(normalised(F.col(text_col))))
    kept = keyed.join(winners, (F.col(sha) == F.col(own)) & F.col(id_col).cast("long").eqNullSafe(F.col(key)))
    if winners.where(F.col(same) > 1).isEmpty():
        return kept.select(*df.columns)
    kept = materialise(kept, "dedup-kept")
    one = kept.where(F.col(same) > 1).groupBy(key, own).agg(F.first(F.struct(*df.columns)).alias(sha)).select(f"{sha}.*")
    return kept.where(F.col(same) == 1).select(*df.columns).unionByName(one)
