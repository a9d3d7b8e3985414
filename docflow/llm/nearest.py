"""Nearest neighbours by a block matrix join of int8 product tiles.

Queries and candidates are dealt into blocks, and a grid of (query block, candidate block) tiles is worked on: each
query block is sent to the tiles of its row, each candidate block to those of its column. In a tile the vectors are
quantised to int8 and multiplied; |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'| bounds the error of each product, so a
candidate whose upper bound is under the k-th best lower bound of the query can't be among the tile's k nearest. The
pairs that survive are computed again in double precision from the original vectors, and bounded heaps merge them:
one for each tile and query, then one for each query over its tiles. The result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block: a tile holds one block of each kind, which bounds its memory.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
#: Rows of a tile multiplied at a time.
STRIP = 128
#: Surviving pairs computed again at a time.
PAIRS = 65536


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows as whole numbers in floats, the scale of each, and the lengths of the rounded rows and of the errors."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # where 1/127 of the largest component is no number
    whole = np.rint(x / scale[:, None])
    back = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component after component in double precision."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * c[:, k]
    return total


def few_of_each(cid: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors those of the n least ids: the others can't be among a query's n - 1 nearest."""
    order = np.lexsort((cid, *c.T))
    cid, c = cid[order], c[order]
    start = np.concatenate([[True], (c[1:] != c[:-1]).any(axis=1)])
    once = start | np.concatenate([[True], cid[1:] != cid[:-1]])
    cid, c, start = cid[once], c[once], start[once]
    i = np.arange(len(cid))
    keep = i - np.maximum.accumulate(np.where(start, i, 0)) < n
    return cid[keep], c[keep]


def tile_nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k nearest candidates of each query in this tile, its own row excepted."""
    if not len(qid) or not len(cid):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    cid, c = few_of_each(cid, c, k + 1)
    q8, qs, q_len, q_err = quantised(q)
    c8, cs, _, c_err = quantised(c)
    c_len = np.linalg.norm(c, axis=1)
    # sums of products of int8 are exact in these floats
    kind = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    c8 = np.ascontiguousarray(c8.T.astype(kind))
    out = []
    for s in range(0, len(qid), STRIP):
        e = s + STRIP
        about = (q8[s:e].astype(kind) @ c8).astype(np.float64) * qs[s:e, None] * cs[None, :]
        slack = (q_err[s:e, None] * c_len[None, :] + q_len[s:e, None] * c_err[None, :]) * (1 + 1e-9) + 1e-12 * np.abs(about)
        own = qid[s:e, None] == cid[None, :]
        low = np.where(own, -np.inf, about - slack)
        high = np.where(own, -np.inf, about + slack)
        n = min(k, low.shape[1])
        bar = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
        row, col = np.nonzero((high >= bar[:, None]) & ~own)
        score = np.concatenate([np.empty(0), *(exact(q[s:e][row[i : i + PAIRS]], c[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS))])
        order = np.lexsort((cid[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < k
        out.append((qid[s:e][row[keep]], cid[col[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query row, its own row excepted.

    * Vectors that are null, empty or zero or hold a null or non-finite component take no part, and neither do null ids.
    * Vectors of different lengths are compared with those of their own length only.
    * Ties go to the smaller id. Repeated rows count once. If vectors differ under one id, each is a candidate, and as a
      query the id gets the nearest to any of them.
    * No usable rows: no rows. Fewer than k candidates: all of them.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    down, across = max(1, math.ceil(sizes["q"] / QUERY_BLOCK)), max(1, math.ceil(sizes["n"] / CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    sent = rows.where("q").select(F.lit(True).alias("q"), block(down).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"), "id", "v")
    held = rows.select(F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), block(across).alias("j"), "id", "v")

    def tile(table: pa.Table) -> pa.Table:
        lists = table["v"].combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
        ids, queries = table["id"].to_numpy(), table["q"].to_numpy()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            x = flat[(ends[at] - d)[:, None] + np.arange(d)]
            m = queries[at]
            out.append(tile_nearest(ids[at][m], x[m], ids[at][~m], x[~m], k))
        return pa.table([np.concatenate(y) for y in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    near = sent.unionByName(held).groupBy("i", "j").applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for b in batches:
            for query, score, vec in zip(*(b.column(x).to_pylist() for x in ("query_id", "score", "vec_id")), strict=True):
                heap, item = heaps[query], (score, -vec)
                if item in heap:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        rows = [(query, n, -vec, score) for query, heap in heaps.items() for n, (score, vec) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    # at most k rows of each query from each tile of its row
    return near.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
