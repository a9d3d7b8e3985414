"""Connected components of links, by large-star and small-star rounds; each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import drop_table, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of ``links`` (u, v, of one type that sorts); root is the least node of the component.

    Minima are aggregated before they are joined back, so that a node with very many links is split like any join key.
    Self-links and nulls are left out; no links, no rows.
    """
    spark = links.sparkSession
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path, schema = write_table(edges, name), edges.schema
    before = None
    while True:
        edges = spark.read.schema(schema).parquet(path)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, path
        path = write_table(_small_star(_large_star(edges)), name)
        drop_table(spark, old)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
