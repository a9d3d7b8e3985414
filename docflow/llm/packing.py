"""Best-fit packing of tokenised documents by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so all that the packing must know of the corpus is how many pieces there
are of each length: a histogram of at most ``capacity`` numbers. The driver plans on it:

1. pieces as long as the capacity are sequences of their own; other lengths over ``small`` are sorted and cut into
   ``groups`` groups of equal cardinality, and each counts as its group's largest;
2. configurations of these few sizes are chosen by the linear program over all of them: the simplex method on one column
   for each size, new columns found by a knapsack of the dual prices. What rounding the program's numbers down leaves is
   put together one configuration at a time, the largest size left first;
3. the actual pieces, longest first, take their group's places, which frees what rounding had added;
4. small lengths, longest first, go where the least room that holds them is left, else into new sequences.

A plan row says where a run of pieces of one length goes (their sequences and offsets are linear in their rank), so
the plan is bounded as well. Pieces are ranked within their length by (length, part) windows, where a part is a hash of
the piece: a length that half of all pieces have is spread over all parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.llm.common import trim, write_table
from docflow.llm.units import units

#: Units that a worker remembers with their ids.
REMEMBERED = 1_000_000
#: Documents split into units at a time.
DOCS_AT_ONCE = 1000
#: Units tokenised as one text.
JOINED = 2_000
PLAN_SCHEMA = "length int, first long, n long, sequence long, offset long, each long"


# ------------------------------------------------------------------------------------------------------ the plan
def most_valuable(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the configuration of the greatest price, any number of each allowed."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, size in enumerate(sizes):
        for start in range(size, capacity + 1, size):  # a copy more in each round
            stop = min(start + size, capacity + 1)
            more = best[start - size : stop - size] + prices[k]
            better = more > best[start:stop] + 1e-12
            best[start:stop][better], last[start:stop][better] = more[better], k
    out, room = np.zeros(len(sizes)), capacity
    while last[room] >= 0:
        out[last[room]] += 1
        room -= sizes[last[room]]
    return out


def best_columns(sizes: list[int], counts: list[int], capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (as columns) and how often each is used, in numbers that aren't whole: the linear program's least
    number of sequences, by column generation. A last round that hasn't come to an end only leaves a larger number."""
    columns = np.diag([float(capacity // x) for x in sizes])
    amounts = np.array(counts) / np.diag(columns)
    for _ in range(rounds):
        prices = np.linalg.solve(columns.T, np.ones(len(sizes)))
        new = most_valuable(sizes, prices, capacity)
        if new @ prices <= 1 + 1e-9:
            break
        step = np.linalg.solve(columns, new)
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amounts = amounts - ratio[out] * step
        columns[:, out], amounts[out] = new, ratio[out]
    return columns, np.maximum(amounts, 0)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(times, places) where places are indices of sizes; sizes fall. All counts are used up."""
    left = list(counts)
    columns, amounts = best_columns(sizes, counts, capacity) if sizes else (np.empty((0, 0)), np.empty(0))
    for column, amount in zip(columns.T.round().astype(int), amounts, strict=True):
        used = np.flatnonzero(column)
        times = min([int(amount + 1e-9), *(left[k] // int(column[k]) for k in used)])
        if times > 0:
            for k in used:
                left[k] -= times * int(column[k])
            yield times, [int(k) for k in used for _ in range(column[k])]
    for top in range(len(sizes)):
        while left[top]:
            room, masks, reach = capacity - sizes[top], [], 1
            limit = (1 << (room + 1)) - 1
            items = [(k, sizes[k], min(left[k] - (k == top), room // sizes[k])) for k in range(top, len(sizes)) if left[k] - (k == top) > 0 and sizes[k] <= room]
            for _, size, most in items:
                masks.append(reach)
                step = 1
                while most > 0:  # 1, 2, 4, ... copies and the rest
                    take = min(step, most)
                    reach |= (reach << (size * take)) & limit
                    most -= take
                    step *= 2
                if reach >> room:
                    break
            fill, places = reach.bit_length() - 1, [top]
            for (k, size, most), mask in zip(reversed(items[: len(masks)]), reversed(masks), strict=True):
                copies = next(c for c in range(most + 1) if fill >= c * size and mask >> (fill - c * size) & 1)
                places += [k] * copies
                fill -= copies * size
            used = {k: places.count(k) for k in places}
            times = min(left[k] // n for k, n in used.items())
            for k, n in used.items():
                left[k] -= times * n
            yield times, places


def plan_packing(histogram: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, n, first sequence, offset, pieces for each sequence): where the pieces of that length
    and of the ranks from ``first`` go. Sequences are numbered from 0."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, n)
    rooms: list[int] = []

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                insort(rooms, left)
            room[left].append((first, n))

    if full := histogram.get(capacity, 0):
        plan.append((capacity, 0, full, 0, 0, 1))
        sequences = full
    large = sorted((x for x in histogram if small < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    size_of_group, runs, sizes, counts = max(1, -(-total // groups)), [], [], []
    for length in large:
        rank, n = 0, histogram[length]
        while n:
            if not counts or counts[-1] == size_of_group:
                sizes.append(length)
                counts.append(0)
                runs.append([])
            take = min(n, size_of_group - counts[-1])
            runs[-1].append([length, rank, take])
            counts[-1] += take
            rank, n = rank + take, n - take
    for times, places in configurations(sizes, counts, capacity):
        while times:
            # the places of one group take its next pieces one after another: of one length as far as it goes
            need = {k: places.count(k) for k in set(places)}
            heads = {k: runs[k][0] for k in need}
            n = min(times, *(h[2] // need[k] for k, h in heads.items()))
            if n:
                offset = 0
                for k in need:
                    length, rank, _ = heads[k]
                    plan.append((length, rank, n * need[k], sequences, offset, need[k]))
                    heads[k][1:] = [rank + n * need[k], heads[k][2] - n * need[k]]
                    offset += length * need[k]
            else:  # one sequence whose places of a group get different lengths
                n, offset = 1, 0
                for k in places:
                    while not runs[k][0][2]:
                        runs[k].pop(0)
                    head = runs[k][0]
                    plan.append((head[0], head[1], 1, sequences, offset, 1))
                    head[1:] = [head[1] + 1, head[2] - 1]
                    offset += head[0]
            for k in need:
                while runs[k] and not runs[k][0][2]:
                    runs[k].pop(0)
            leave(capacity - offset, sequences, n)
            sequences, times = sequences + n, times - n

    def put(length: int, rank: int, n: int, first: int, left: int) -> None:
        each = left // length
        for k, bins in ((each, n // each), (n % each, 1)):
            if k and bins:
                plan.append((length, rank, k * bins, first, capacity - left, k))
                leave(left - k * length, first, bins)
                rank, first = rank + k * bins, first + bins

    for length in sorted((x for x in histogram if 0 < x <= small and x < capacity), reverse=True):
        rank, n = 0, histogram[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(length, rank, n, sequences, capacity)
                sequences += -(-n // (capacity // length))
                break
            left = rooms[at]
            first, bins = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(at)
            each = left // length
            take = min(n, each * bins)
            used = -(-take // each)
            leave(left, first + used, bins - used)
            put(length, rank, take, first, left)
            rank, n = rank + take, n - take
    return plan


# ------------------------------------------------------------------------------------------------------ tokens
@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """One per worker, with which ids begin with a space, and the ids of the units seen last."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = False
    spaced = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
    spaced[[i for x, i in tokenizer.get_vocab().items() if x.startswith("\u0120")]] = True  # how the byte 0x20 is written
    return tokenizer, spaced, {}, {}


def token_bytes(texts: list[str], path: str, remembered: int = REMEMBERED) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    tokenizer, spaced, heads, tails = tokenizer_of(path)
    for known in (heads, tails):
        if len(known) > remembered:  # short ones come again most
            short = {x: known[x] for x in known if len(x) < 6}
            known.clear()
            known.update(short if len(short) < remembered / 2 else {})
    parts = [units(x) if x else [] for x in texts]
    new = list({p[0] for p in parts if p} - heads.keys())
    heads.update((x, np.array(e.ids, dtype="<u4").tobytes()) for x, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
    new = list(set(chain.from_iterable(p[1:] for p in parts)).difference(tails))
    alone = [x for x in new if " " in x or "<|" in x]
    tails.update((x, np.array(e.ids, dtype="<u4").tobytes()) for x, e in zip(alone, tokenizer.encode_batch_fast([" " + x for x in alone], add_special_tokens=False), strict=True))
    new = [x for x in new if " " not in x and "<|" not in x]
    for i in range(0, len(new), JOINED):  # units don't touch each other, so many are one text; each begins at its only space
        run = new[i : i + JOINED]
        ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(run)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.append(np.flatnonzero(spaced[ids]), len(ids)) * 4
        raw = ids.tobytes()
        tails.update(zip(run, (raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), strict=True))
    for p in parts:
        yield heads[p[0]] + b"".join(map(tails.__getitem__, p[1:])) if p else b""


def cut_pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut if longer than ``capacity``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                b = batch.slice(lo, DOCS_AT_ONCE)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(b.column(0).to_pylist(), token_bytes([x or "" for x in b.column(1).to_pylist()], path, remembered), strict=True):
                    view = memoryview(ids + end)
                    n = len(view) // 4
                    first = n % capacity or capacity
                    starts = [0, *range(first, n, capacity)]
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        for column, value in zip(rows, (doc, k, s, e - s, zlib.crc32(view[4 * s : 4 * e])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if remembered < REMEMBERED:  # memory is short, so nothing is kept for the worker's next task
            tokenizer_of.cache_clear()
        trim()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------------------------------------------ the operator
def pack(pieces: DataFrame, capacity: int = 1024, small: int | None = None, groups: int = 96, part_rows: int = 1000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (from 1 to ``capacity``). Lengths up to ``small``
    (three eighths of the capacity) are placed by best fit, longer ones in ``groups`` groups.

    ``pieces`` is read three times, so it should be a table. Pieces of one length are interchangeable; their places
    follow (part, doc_id, piece). Repeated rows are pieces of their own. No rows in, no rows out. Columns
    beside the three may have any names but those of the result.
    """
    spark, small = pieces.sparkSession, 3 * capacity // 8 if small is None else small
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_packing(histogram, capacity, small, groups), PLAN_SCHEMA)
    parts = spark.createDataFrame([(x, 1 + n // part_rows) for x, n in histogram.items()], "length long, parts long")  # at most `capacity` rows
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("nth", nth).join(offsets, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    # bounded: some rows for each of `capacity` lengths and `groups` sizes
    runs = F.broadcast(plan.withColumnRenamed("length", "run_length").withColumnRenamed("offset", "run_offset"))
    inside = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    k = F.col("rank") - F.col("first")
    placed = ranked.join(runs, inside)
    return placed.select(*pieces.columns, (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("run_offset") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Tokenises documents and packs them: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    Null texts count as empty: their one piece is the end id. Very long texts give as many pieces as they need.
    Documents with the same id, and repeated rows, are packed each for itself. No rows in, no rows out. Only the two
    columns named are read, whatever others there are.
    ``remembered``: units a worker keeps with their ids; fewer take less memory and more time, the ids are the same.
    The pieces are written to the shared folder, so no text is tokenised twice.
    """
    spark, pieces = df.sparkSession, cut_pieces(df, path, capacity, end_id, id_col, text_col, remembered)
    return pack(spark.read.schema(pieces.schema).parquet(write_table(pieces, "pieces")), capacity)
