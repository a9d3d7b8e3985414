"""Whitening of embeddings: a singular value decomposition of centred, distributed rows.

Vectors become whole numbers (steps of 1 / 256), so that sums, deviations and the total variance are exact. Each
distinct vector counts once. MLlib's ``computeSVD`` decomposes the centred rows; it knows no divisor, so an eigenvalue
of the covariance is a squared singular value by n. What the rows vary in total comes from their exact deviations, not
from the decomposition, which it checks: so does ``identity_error``, the covariance that whitened rows really have.

The driver holds the sums and the covariance of the dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import drop_table, write_table

#: Steps in which a component is measured.
STEPS = 256
#: Up to so many dimensions all singular values are asked for, which MLlib does by a dense decomposition.
DENSE_DIMENSIONS = 15_000
#: An eigenvalue below this share of the largest is rounding, and its component isn't returned.
LEAST_EIGENVALUE = 1e-12

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whole_steps(vector: Column) -> Column:
    """A vector's entries, as doubles, in whole steps."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(0).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is one: neither null nor with null or non-finite entries."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


@dataclass(frozen=True)
class Moments:
    """Of the distinct vectors: their number, sums by dimension, and whether squared deviations fit long integers."""

    n: int
    sums: list[int]
    narrow: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)^2, exact."""
        kind = np.int64 if self.narrow else object
        return ((x.astype(kind) * self.n - np.array(self.sums, kind)) ** 2).sum(axis=1).tolist()


def moments(fit: DataFrame) -> Moments | None:
    """Of vectors of whole numbers, all of one length; None of an empty table."""
    each = fit.select(F.posexplode("x").alias("pos", "c")).groupBy("pos")
    found = each.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high"))
    rows = sorted(found.collect(), key=lambda r: r["pos"])  # one for each dimension
    if not rows:
        return None
    n, largest = rows[0]["n"], max(max(abs(r["low"]), abs(r["high"])) for r in rows)
    return Moments(n, [int(r["s"]) for r in rows], len(rows) * (2 * n * largest) ** 2 < 2**63)


def components(fit: DataFrame, found: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the covariance, falling, and their unit eigenvectors as columns. The largest entry of
    each eigenvector is positive."""
    dims = len(found.sums)
    means = F.array(*(F.lit(s / found.n) for s in found.sums))
    rows = fit.select(array_to_vector(F.zip_with("x", means, lambda x, m: x.cast("double") - m)).alias("row"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"))
    svd = matrix.computeSVD(dims if dims <= DENSE_DIMENSIONS else k)
    values = svd.s.toArray() ** 2 / found.n
    vectors = svd.V.toArray()
    k = min(k, int((values > LEAST_EIGENVALUE * values[0]).sum())) if len(values) and values[0] > 0 else 0
    vectors = vectors[:, :k]
    turned = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)]) if k else np.ones(0)
    return values[:k], vectors * turned


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def spread(fit: DataFrame, found: Moments, to_white: np.ndarray) -> tuple[float, float]:
    """The total variance, and the largest difference between the whitened rows' covariance and the identity."""
    dims, k = to_white.shape
    schema = ", ".join(["total double", *(f"m{i} double" for i in range(k)), *(f"c{i}_{j} double" for i in range(k) for j in range(k))])

    def each_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = matrix_of(batch.column(0), dims)
            total += sum(found.deviations(x))
            white = found.centred(x) @ to_white
            first, second = first + white.sum(axis=0), second + white.T @ white
        # the deviations sum up to n^3 times the total variance
        yield pa.RecordBatch.from_pylist([dict(zip(names, [total / found.n**3, *first.tolist(), *second.ravel().tolist()], strict=True))])

    names = [c.split()[0] for c in schema.split(", ")]
    row = fit.select("x").mapInArrow(each_task, schema).agg(*(F.sum(c).alias(c) for c in names)).first()
    mean = np.array([row[f"m{i}"] for i in range(k)]) / found.n
    covariance = np.array([[row[f"c{i}_{j}"] for j in range(k)] for i in range(k)]).reshape(k, k) / found.n - np.outer(mean, mean)
    return row["total"], float(np.abs(covariance - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and each of the first ``k`` components: vec_id, component (from 1), n (distinct vectors),
    deviation, whitened, explained (the component's share of the total variance), identity_error, deviation_exact.

    * Vectors that are null or hold null, NaN or infinite entries are left out; a null id stays null.
    * Repeated rows and rows of one id each get their rows; equal vectors count once in the fit.
    * Vectors are as long as most are (of as many, the longer); rows of other lengths, empty vectors among them, are left out.
    * Components without variance have no row: of one distinct vector there is none, nor of an empty table.
    * Equal eigenvalues (ties): any orthogonal directions in their space.
    * ``deviation`` is null where it doesn't fit a long, ``deviation_exact`` where it doesn't fit 38 digits.
    * Texts play no part. Only the two columns named are read, whatever the others are called.
    """
    spark = df.sparkSession
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    lengths = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None or not lengths["dims"]:
        return spark.createDataFrame([], OUT)
    dims = lengths["dims"]
    kept = kept.where(F.size("v") == dims).select("vec_id", whole_steps(F.col("v")).alias("x"))
    table = write_table(kept.select("x").distinct(), "whitening-fit")
    fit = spark.read.schema("x array<long>").parquet(table)
    found = moments(fit)
    values, vectors = components(fit, found, k)
    to_white = vectors / np.sqrt(values)
    total, error = spread(fit, found, to_white) if len(values) else (1.0, 0.0)
    drop_table(spark, table)
    if not len(values):
        return spark.createDataFrame([], OUT)
    explained = values / total

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(values)
        schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_exact", pa.decimal128(38, 0))])
        for batch in batches:
            x = matrix_of(batch.column(1), dims)
            deviations, size = found.deviations(x), len(x) * m
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m))),
                np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)),
                np.full(size, found.n),
                [d if d < 2**63 else None for d in deviations for _ in range(m)],
                (found.centred(x) @ to_white).ravel(),
                np.tile(explained, len(x)),
                np.full(size, error),
                [d if d < 10**38 else None for d in deviations for _ in range(m)],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return kept.mapInArrow(rows, OUT)
