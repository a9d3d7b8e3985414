"""Similarity join of documents on the Jaccard similarity of their five-word shingles.

Prefix filtering, rarest shingles first: two sets that reach the threshold share one of the shingles of their prefixes.

1. Every text is read once for its set's size and digest (96 bits) and for a sketch of all shingles' counts, whose size
   is fixed. What a counter holds above its share of all shingles tells frequent shingles from rare ones, whatever the
   input's size; hashes break ties. Any order gives right results.
2. Every text is read again; the prefix of each distinct set goes, packed into arrays, to the buckets of its shingles.
   Equal sets collapse there (and in each input block before), so copies cost one entry. A frequent shingle has several
   buckets, in proportion to its count. Shingles that several sets share come out with the sets' sizes and places.
3. Candidates are made in two steps. First each set meets its shingle's hub (the set of the least digest in the bucket),
   which makes as many pairs as entries; the pairs that pass the length and positional filters are verified, and their
   links grouped into components. Then sets of one shingle and of like size meet if they are in different components.
   So a large group of near copies never gives all its pairs, and no link between components is missed: every link has
   its ends in one component in the end.
4. Pairs are distinct, so each is verified once: whole sets are built anew from the texts. Ranges of hashes are counted in
   each set, four shingles a range; two sets differ at least as much as their counts do, so most pairs that share only a
   passage are told apart by counts a thirtieth as large as the sets. The sets of the others meet, are partitioned at
   pivots for the suffix filter, and intersected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import buckets_for, drop_table, finished, fresh, materialise, trim, write_table
from docflow.llm.components import components
from docflow.llm.words import mixed, shingle_hashes, slices, word_hashes

SKETCH_BITS = 21
SKETCH_PARTS = 32
#: Occurrences of a shingle for each of its buckets.
SALT_COUNT = 200_000
#: Groups that the partners of one set are dealt into.
HUB_SALTS = 16
#: Parts of the sketch that one task adds up.
PARTS_AT_ONCE = 64
#: Rows of ids, pairs and nodes that are sent to all executors at most; more are met by a shuffle.
FEW_IDS = 200_000


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least part / whole, in whole numbers."""

    part: int = 75
    whole: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Of a set of n, how many shingles any set that reaches the threshold must share one of."""
        return n - -(-self.part * n // self.whole) + 1

    def overlap(self, n: int, m: int) -> int:
        """The least intersection of sets of n and m that reach the threshold."""
        return -(-self.part * (n + m) // (self.part + self.whole))


def document_sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For runs of rows of (doc_id, text): the ids, all sets' sorted shingles one after another, and n + 1 offsets."""
    for part in slices(batch, 1):
        words, counts = word_hashes(part.column(1))
        shingles, texts = shingle_hashes(words, counts)
        order = np.lexsort((shingles, texts))
        shingles, texts = shingles[order], texts[order]
        new = np.ones(len(texts), dtype=bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1])
        shingles, texts = shingles[new], texts[new]
        yield part.column(0), shingles, np.searchsorted(texts, np.arange(part.num_rows + 1))


def fingerprint(shingles: np.ndarray) -> bytes:
    """Names a set: 96 bits of a digest of its shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest()


def survey(rows: DataFrame) -> DataFrame:
    """A row for each document (doc_id, set_id, n), and rows of the sketch (part, counts). set_id of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, mask = np.zeros(1 << SKETCH_BITS, dtype=np.int64), np.uint64((1 << SKETCH_BITS) - 1)
        names = ["doc_id", "set_id", "n", "part", "counts"]
        for batch in batches:
            for ids, shingles, at in document_sets(batch):
                sketch += np.bincount((shingles & mask).astype(np.int64), minlength=len(sketch))
                sets = [fingerprint(shingles[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                k = len(sets)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        trim()
        blocks = np.minimum(sketch, 2**32 - 1).astype("<u4").reshape(SKETCH_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_PARTS, t) for t in (pa.int64(), pa.binary(), pa.int64())] + [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names)

    return rows.mapInArrow(run, "doc_id long, set_id binary, n long, part int, counts binary")


def add_up(parts: DataFrame) -> np.ndarray:
    """The sketch of all rows: 2 ** SKETCH_BITS numbers, whatever the input's size."""

    def total(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_py(), dtype="<u4").astype(np.uint64) for x in table["counts"])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "counts": pa.array([np.minimum(counts, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    tasks = parts.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    while tasks > PARTS_AT_ONCE:  # so that no task gets a part from every task of the survey
        tasks = -(-tasks // PARTS_AT_ONCE)
        parts = materialise(parts.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(tasks))).applyInArrow(total, "part int, counts binary"), "jaccard-sketch")
    found = {r["part"]: r["counts"] for r in parts.groupBy("part").applyInArrow(total, "part int, counts binary").collect()}
    empty = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, dtype="<u4").tobytes()
    return np.frombuffer(b"".join(found.get(k, empty) for k in range(SKETCH_PARTS)), dtype="<u4")


SET = "set_id binary, size int, ranges binary, shingles binary"
#: Added to the place in entries of shingles with several buckets.
HOT_MARK = 1 << 31

#: An entry of a bucket: shingle, set (two parts), place of the shingle in the set's order, size of the set. 48 bits of the
#: shingle are sent: shingles taken for one another only make pairs that are found to have no link.
ENTRY = np.dtype([("shingle", "<u8"), ("lo", "<u8"), ("hi", "<u4"), ("place", "<u4"), ("size", "<u4")])
NAME = np.dtype([("lo", "<u8"), ("hi", "<u4")])
SENT_BYTES = {c: 6 if c == "shingle" else ENTRY[c].itemsize for c in ENTRY.names}


def entries(rows: DataFrame, often: np.ndarray, n_buckets: int, limit: Threshold, salt_count: int) -> DataFrame:
    """bucket, packed: the prefixes of the distinct sets of each block, packed by bucket column after column.
    ``often``: about how often shingles occur, by the sketch."""
    sent = rows.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, mask = sent.value, np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for ids, shingles, at in document_sets(batch):
                owner = np.repeat(np.arange(len(ids)), np.diff(at))
                often = counted[(shingles & mask).astype(np.int64)]
                order = np.lexsort((shingles, often, owner))
                seen: set[bytes] = set()
                names = [fingerprint(shingles[a:b]) if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
                chosen = np.zeros(len(ids), dtype=bool)
                for i, name in enumerate(names):
                    chosen[i] = name != b"" and name not in seen
                    seen.add(name)
                n = np.diff(at)
                place = np.arange(len(shingles)) - np.repeat(at[:-1], n)
                keep = chosen[owner] & (place < limit.prefix(n)[owner])
                rank, place, owner = order[keep], place[keep], owner[keep]
                out = np.empty(len(rank), dtype=ENTRY)
                salts = 1 + often[rank].astype(np.int64) // salt_count
                out["shingle"], out["place"], out["size"] = shingles[rank], place.astype(np.uint32) + ((salts > 1) * HOT_MARK).astype(np.uint32), n[owner]
                halves = np.frombuffer(b"".join(x or bytes(12) for x in names), dtype=NAME)
                out["lo"], out["hi"] = halves["lo"][owner], halves["hi"][owner]
                key = out["shingle"] ^ mixed(out["lo"] % salts.astype(np.uint64))
                bucket = ((key >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                out, bucket = out[by], bucket[by]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=n_buckets))
                columns = [np.ascontiguousarray(out[c]).view(np.uint8).reshape(len(out), ENTRY[c].itemsize)[:, :width] for c, width in SENT_BYTES.items()]
                packed = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "packed"])
        trim()

    return rows.mapInArrow(run, "bucket int, packed binary")


def unpacked(packed: bytes) -> np.ndarray:
    n, at = len(packed) // sum(SENT_BYTES.values()), 0
    out = np.empty(n, dtype=ENTRY)
    for c, width in SENT_BYTES.items():
        whole = np.zeros((n, ENTRY[c].itemsize), dtype=np.uint8)
        whole[:, :width] = np.frombuffer(packed, dtype=np.uint8, count=n * width, offset=at).reshape(n, width)
        out[c] = whole.view(ENTRY[c])[:, 0]
        at += n * width
    return out


def binary(lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Names of sets from their parts."""
    raw = np.empty(len(lo), dtype=NAME)
    raw["lo"], raw["hi"] = lo, hi
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((np.arange(len(lo) + 1) * NAME.itemsize).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def shared(packed: DataFrame, n_buckets: int) -> DataFrame:
    """shingle, set_id, size, place, hub, hub_size, hub_place, more: an entry for each set of the shingles that several
    sets have, with the hub among them. Shingles with several buckets have a hub in each and keep single entries. more:
    whether others than the hub can have the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.setdefault(b, []).append(unpacked(x.as_py()))
        while parts:
            e = np.concatenate(parts.popitem()[1])
            e = e[np.lexsort((e["place"], e["lo"], e["hi"], e["shingle"]))]
            new = np.ones(len(e), dtype=bool)
            new[1:] = (e["shingle"][1:] != e["shingle"][:-1]) | (e["lo"][1:] != e["lo"][:-1]) | (e["hi"][1:] != e["hi"][:-1])
            e = e[new]
            first = np.ones(len(e), dtype=bool)
            first[1:] = e["shingle"][1:] != e["shingle"][:-1]
            heads = np.flatnonzero(first)
            many = np.diff(np.append(heads, len(e)))
            hot = e["place"] >= HOT_MARK
            e["place"] -= (hot * HOT_MARK).astype(np.uint32)
            hub = np.repeat(heads, many)
            keep = (np.repeat(many, many) > 1) | hot
            e, hub, more = e[keep], e[hub[keep]], (hot | (np.repeat(many, many) > 2))[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(e["shingle"].view(np.int64)), binary(e["lo"], e["hi"]), pa.array(e["size"].astype(np.int32)), pa.array(e["place"].astype(np.int32)), binary(hub["lo"], hub["hi"]), pa.array(hub["size"].astype(np.int32)), pa.array(hub["place"].astype(np.int32)), pa.array(more)],
                ["shingle", "set_id", "size", "place", "hub", "hub_size", "hub_place", "more"],
            )
        trim()

    return packed.repartition(n_buckets, "bucket").mapInArrow(run, "shingle long, set_id binary, size int, place int, hub binary, hub_size int, hub_place int, more boolean")


def filtered(limit: Threshold, n: str, i: str, m: str, j: str):
    """Length filter, and positional filter: what stands from the shared shingle on must be able to reach the overlap.
    The first shared shingle of a pair that reaches the threshold passes."""
    part, whole = limit.part, limit.whole
    length = (F.col(n) * whole >= F.col(m) * part) & (F.col(m) * whole >= F.col(n) * part)
    left = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)).cast("long")
    return length & (left * (part + whole) >= (F.col(n) + F.col(m)).cast("long") * part)


def far_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """Suffix filter: a lower bound of the symmetric difference of two sorted sets, split at a pivot of the larger one;
    stops once it is over ``most``."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    if len(x) < len(y):
        x, y = y, x
    mid = len(x) // 2
    at = int(np.searchsorted(y, x[mid]))
    found = at < len(y) and y[at] == x[mid]
    low = abs(mid - at)
    high = abs((len(x) - mid - 1) - (len(y) - at - found))
    own = 0 if found else 1
    if low + high + own > most:
        return low + high + own
    low = far_apart(x[:mid], y[:at], most - high - own, depth - 1)
    if low + high + own > most:
        return low + high + own
    return low + own + far_apart(x[mid + 1 :], y[at + found :], most - low - own, depth - 1)


def alike(x: np.ndarray, y: np.ndarray, limit: Threshold) -> bool:
    """Whether two sorted sets reach the threshold."""
    need = limit.overlap(len(x), len(y))
    if min(len(x), len(y)) < need or far_apart(x, y, len(x) + len(y) - 2 * need) > len(x) + len(y) - 2 * need:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) >= need


def range_counts(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles are in each of 2 ** k equal ranges of hashes, about four a range; 255 stands for more."""
    k = max(3, round(math.log2(max(len(shingles), 1) / 4))) if len(shingles) > 4 else 3
    return np.minimum(np.bincount((shingles >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def at_least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by their range counts."""
    a, b = (np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in (x, y))
    if len(a) != len(b):  # neighbouring ranges of the finer one together
        if len(a) < len(b):
            a, b = b, a
        if (a == 255).any() or (b == 255).any():
            return 0
        a = a.reshape(len(b), -1).sum(axis=1)
    return int(np.abs(a - b).sum())


def plausible(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (u, v) whose range counts don't rule out the threshold, as a table."""
    light = sets.select("set_id", "size", "ranges").dropDuplicates(["set_id"])
    met = pairs.select("u", "v")
    for end in "uv":
        met = met.join(light.select(F.col("set_id").alias(end), F.col("size").alias(f"{end}_size"), F.col("ranges").alias(f"{end}_ranges")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("u_size", "v_size", "u_ranges", "v_ranges")), strict=True)
            keep = [at_least_apart(x, y) <= n + m - 2 * limit.overlap(n, m) for n, m, x, y in rows]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return materialise(met.mapInArrow(run, "u binary, v binary"), "jaccard-plausible")


def verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The links (u, v) among distinct pairs (u, v) of set ids; ``sets`` has set_id and the sorted shingles as bytes."""
    salt = F.pmod(F.xxhash64("u"), F.lit(HUB_SALTS)).cast("int").alias("salt")
    hubs, small = pairs.select("v", salt).distinct(), pairs.count() <= FEW_IDS  # no more hubs than pairs
    # the set of each pair's first end goes to the second's, which is sent once for each of its salts
    firsts = sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("x")).join(sent(pairs, small), "u").select("u", "v", salt, "x")
    seconds = sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("y")).join(sent(hubs, small), "v")
    met = firsts.join(seconds, ["v", "salt"]).select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8"), limit) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return met.mapInArrow(run, "u binary, v binary")


def sets_of(rows: DataFrame, wanted: DataFrame, with_node: DataFrame) -> DataFrame:
    """Rows of SET (shingles sorted, as bytes) of the set ids in ``wanted`` at least, built from the texts of one document each; sets
    that only rows of null id have are built from all such rows."""
    one = materialise(with_node.where("least IS NOT NULL").join(few(wanted), "set_id", "left_semi").select("set_id", F.col("least").alias("doc_id")), "jaccard-chosen")
    small = one.count() <= FEW_IDS
    ids = one.select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shingles, at in document_sets(batch):
                found = [shingles[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
                columns = [pa.array([f(x) for x in found], t) for f, t in ((fingerprint, pa.binary()), (len, pa.int32()), (range_counts, pa.binary()), (np.ndarray.tobytes, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["set_id", "size", "ranges", "shingles"])
        trim()

    build = lambda some: some.mapInArrow(run, SET)
    built = build(rows.join(sent(ids, small), "doc_id", "left_semi"))
    rest = wanted.join(one, "set_id", "left_anti")
    if not rest.isEmpty():
        built = built.unionByName(build(rows.where("doc_id IS NULL")))
    return built  # rows that share an id can bring other sets, or one set twice, which does no harm


def node_of(least: Column, set_id: Column) -> Column:
    """A name for a set that sorts by its least id (nulls last), then by the set."""
    flipped = F.lpad(F.hex(F.coalesce(least, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.unhex(F.concat(F.when(least.isNull(), "01").otherwise("00"), flipped)), set_id)


def least_of(node: Column) -> Column:
    """The id that node_of was given."""
    digits = F.hex(node)
    return F.when(F.substring(digits, 1, 2) == "00", F.conv(F.substring(digits, 3, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63))))


def similar_groups(df: DataFrame, limit: Threshold | None = None, id_col: str = "doc_id", text_col: str = "text", salt_count: int = SALT_COUNT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; component_id is the least id reachable by links.

    * Null texts and texts without words have no shingles and link with nothing; fewer than five words are one shingle.
      Very long texts are one set each.
    * Equal sets are linked, however many rows have them. Ties and repeated rows therefore share a component.
    * Rows of one id are a row each, linked by their own texts. Rows of null id are linked like all others, and are
      nobody's component_id unless all ids of the component are null.
    * No rows in, no rows out. Only the two columns named are read.

    The result is a table; all others are removed once it is written, the large ones once nothing reads them.
    """
    return finished(df.sparkSession, lambda: grouped(df, limit or Threshold(), id_col, text_col, salt_count), "jaccard-found")


def grouped(df: DataFrame, limit: Threshold, id_col: str, text_col: str, salt_count: int) -> DataFrame:
    """As similar_groups, whose result isn't written yet."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark, seen = df.sparkSession, survey(rows)
    survey_path = write_table(seen, "jaccard-survey")
    surveyed = spark.read.schema(seen.schema).parquet(survey_path)
    known = materialise(surveyed.where("part IS NULL").select("doc_id", "set_id", "n"), "jaccard-known")
    sketch = add_up(surveyed.where("part IS NOT NULL").select("part", "counts"))
    drop_table(spark, survey_path)  # every task of the survey has left a sketch
    total = int(known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    share = total >> SKETCH_BITS
    often = np.maximum(sketch, share).astype("<u4") - np.uint32(share)
    n_buckets = buckets_for(total * ENTRY.itemsize * (1 - limit.part / limit.whole))
    met_path = write_table(shared(entries(rows, often, n_buckets, limit, salt_count), n_buckets), "jaccard-shared")
    met = spark.read.schema("shingle long, set_id binary, size int, place int, hub binary, hub_size int, hub_place int, more boolean").parquet(met_path)
    with_node = known.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    with_node = materialise(with_node.select("set_id", "least", node_of(F.col("least"), F.col("set_id")).alias("node")), "jaccard-sets")

    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    to_hub = met.where((F.col("set_id") != F.col("hub")) & filtered(limit, "size", "place", "hub_size", "hub_place")).select(F.col("set_id").alias("u"), F.col("hub").alias("v")).distinct()
    first_pairs = materialise(to_hub, "jaccard-pairs")
    first_links = materialise(as_nodes(link(rows, with_node, first_pairs, limit), with_node), "jaccard-links")
    groups = materialise(components(first_links), "jaccard-groups")

    # shingles whose sets are still in several components
    roots = materialise(with_node.join(few(groups), "node").select("set_id", "root"), "jaccard-roots")
    own = met.where("more").select("shingle", "set_id", "size", "place").join(few(roots), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    open_path, own_schema = write_table(own, "jaccard-open"), own.schema
    drop_table(spark, met_path)
    own = spark.read.schema(own_schema).parquet(open_path)
    mixed_ = own.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("shingle")
    # sizes that the length filter lets meet are in one band or in neighbouring ones
    band = F.floor(F.log("size") / (1.001 * math.log(limit.whole / limit.part)))
    open_ = own.join(mixed_, "shingle", "left_semi").withColumn("band", band)
    x, y = (open_.select(F.col("shingle").alias(f"{p}_shingle"), *(F.col(c).alias(f"{p}_{c}") for c in ("set_id", "size", "place", "root", "band"))) for p in "xy")
    y = y.withColumn("near", F.explode(F.sequence(F.col("y_band") - 1, F.col("y_band"))))  # x is of the lower band
    first = (F.col("x_band") < F.col("y_band")) | (F.col("x_set_id") < F.col("y_set_id"))
    apart = (F.col("x_root") != F.col("y_root")) & first & filtered(limit, "x_size", "x_place", "y_size", "y_place")
    rest = x.join(y, (F.col("x_shingle") == F.col("y_shingle")) & (F.col("x_band") == F.col("near")) & apart).select(*ordered("x_set_id", "y_set_id")).distinct()
    rest = rest.join(first_pairs.select(*ordered("u", "v")), ["u", "v"], "left_anti")
    second_pairs = materialise(rest, "jaccard-pairs")
    drop_table(spark, open_path)
    second_links = as_nodes(link(rows, with_node, second_pairs, limit), with_node)

    stars = groups.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    found = materialise(components(stars.unionByName(second_links)), "jaccard-groups")
    named = with_node.join(few(found), "node", "left").select("set_id", least_of(F.coalesce("root", "node")).alias("component_id"))
    whole = known.where("set_id IS NOT NULL").join(named, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(known.where("set_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def sent(frame: DataFrame, small: bool) -> DataFrame:
    """The frame, sent to all executors where it is known to be small."""
    return F.broadcast(frame) if small else frame


def few(frame: DataFrame) -> DataFrame:
    """The frame (a table, so that it isn't worked out to be counted), sent to all executors where it is small."""
    return sent(frame, frame.count() <= FEW_IDS)


def as_nodes(links: DataFrame, with_node: DataFrame) -> DataFrame:
    """Links (u, v) of sets, a table, as links of their nodes: as many."""
    small = links.count() <= FEW_IDS
    for end in "uv":
        links = with_node.select(F.col("set_id").alias(end), "node").join(sent(links, small), end).drop(end).withColumnRenamed("node", end)
    return links.select("u", "v")


def link(rows: DataFrame, with_node: DataFrame, pairs: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs that reach the threshold, as a table."""
    wanted = materialise(pairs.select(F.col("u").alias("set_id")).unionAll(pairs.select(F.col("v").alias("set_id"))).distinct(), "jaccard-wanted")
    path = write_table(sets_of(rows, wanted, with_node), "jaccard-shingles")
    sets = rows.sparkSession.read.schema(SET).parquet(path)
    links = materialise(verified(plausible(pairs, sets, limit), sets, limit), "jaccard-links")
    drop_table(rows.sparkSession, path)
    return links


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, that of the least id: the rows of ``df``, with all their columns (whatever
    their names), but for those of ids of which every row has a smaller component_id.

    Rows without shingles (null and empty texts) stay, and so do rows of null id. Rows of one id, repeated ones among
    them, stay or go together. No rows in, no rows out.
    """
    groups = similar_groups(df, id_col=id_col, text_col=text_col)
    (name,) = fresh(df, "gone")
    gone = groups.groupBy("doc_id").agg(F.max("component_id").alias("component_id")).where("component_id < doc_id").select(F.col("doc_id").alias(name))
    return df.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
