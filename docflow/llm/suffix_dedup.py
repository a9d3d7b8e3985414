"""Removal of byte strings that an earlier document has, on merged Burrows-Wheeler transforms.

A string of ``length`` bytes is looked for in all documents of smaller id. No task sees the whole corpus:

1. In each text the minimum of the hashes of the ``K``-byte strings within each window of ``length`` bytes marks an
   anchor. Equal windows have equal anchors at the same place, so only windows whose anchor several texts share can
   repeat. Anchors are packed into arrays and meet in buckets by their hash.
2. The windows of a shared anchor lie in one run; the run with the bytes of its last window is a context. Contexts
   meet in buckets by their anchor; equal contexts collapse there.
3. Contexts fall into halves by a core, some more bytes about their anchor that their windows share. Where a core has
   several halves, they are dealt into shards, and each shard gets its Burrows-Wheeler transform (a half that is alone
   with its core shares its windows with its copies only). Transforms are
   merged in pairs by refining their interleave: in each round the interleave is dealt out anew by the symbols that
   precede, so after h rounds suffixes stand in the order of their first h bytes. The round in which two neighbours part
   is their longest common prefix, so what never parts in ``length`` rounds is an interval of repeats; suffixes are not
   sorted again. The least document of an interval decides for all its windows.
4. Windows found in smaller documents go back to their texts, which cover their bytes.

Equal texts collapse before all this, by their digest: a task sends a text once, and a text with very many rows (its
digest is counted first) is sent by the row of its least id only. Rows of the least id are judged as above, the others
repeat it throughout. A task sends an anchor for two of its texts at most: that tells that several texts share it, and
its other texts are marked at once.

What stays in one place is what different contexts one anchor of ``K`` bytes has: they are split there, in linear time.
Transforms of one core's halves are sharded and merged, but within one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import buckets_for, text_bytes, trim, write_table
from docflow.llm.suffix_tree_lm import by_bucket, find_in
from docflow.llm.words import mixed, slices, text_bytes_of

LENGTH = 50
#: Bytes of an anchor.
K = 20
#: Bytes of contexts in a shard, and in what is merged of its own (more if one anchor has more).
SHARD_BYTES, GROUP_BYTES = 1 << 17, 1 << 17
#: Anchors that a task combines before it sends them.
HELD_ANCHORS = 500_000
#: A text with more rows than this and than this share of all is sent by one row only; there are 1 / HOT_SHARE at most.
HOT_ROWS, HOT_SHARE = 256, 1e-5
#: Bytes of text whose anchors are looked for at a time; each takes some ten numbers of eight bytes.
PART_BYTES = 1 << 20
NO_ID = 2**63 - 1
_VALUE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0xD1342543DE82EF95


# ------------------------------------------------------------------------------------------------------ anchors
def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling: each step joins two neighbouring stretches."""
    block, width, n = _VALUE[data], 1, len(data) - k + 1
    out, done = np.zeros(n, dtype=np.uint64), 0
    while True:
        if k & width:
            out += block[done : done + n] * power_of(done)
            done += width
        if 2 * width > k:
            return mixed(out)
        block = block[:-width] + block[width:] * power_of(width)
        width *= 2


def power_of(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor its hash (48 bits), its text, and the first and last window (places in ``data``) that it stands for."""
    nothing = np.empty(0, np.int64)
    if len(data) < length:
        return nothing.astype(np.uint64), nothing, nothing, nothing
    hashes = window_hashes(data, K) >> np.uint64(16)
    # by the upper bits of the hash, then by place
    bits = np.uint64(len(data)).item().bit_length()
    order = ((hashes >> np.uint64(max(0, bits - 16))) << np.uint64(bits)) | np.arange(len(hashes), dtype=np.uint64)
    best = (sliding_min(order, length - K + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(best)), side="right") - 1 if len(offsets) < 3 else np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
    inside = np.arange(len(best)) + length <= offsets[text + 1]
    new = inside.copy()
    new[1:] &= (best[1:] != best[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    return hashes[best[first]], text[first], first, last


# ------------------------------------------------------------------------------------------- the transforms
def transform(symbols: np.ndarray, strings: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of strings one after another, each followed by symbol 0. The ends are
    ordered by their strings. Ranks by eight symbols first, then by twice as many in each round."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, symbols.dtype)]).astype(np.uint64)
    packed, ended, bits = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool), np.uint64(8 if symbols.dtype == np.uint8 else 9)
    steps = 64 // int(bits)
    for k in range(steps):
        packed = (packed << bits) | np.where(ended, np.uint64(0), padded[k : k + n])
        ended |= padded[k : k + n] == 0
    order = np.argsort(packed, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = (packed[order[1:]] != packed[order[:-1]]) | ended[order[1:]]
    width = steps
    rank = np.empty(n, dtype=np.int64)
    while True:
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        key = rank[order] * n + rank[np.minimum(order + width, n - 1)]  # in order but for ties, which are short runs
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        new[1:] = key[1:] != key[:-1]
        width *= 2
    return order, symbols[order - 1]


class Merged:
    """A Burrows-Wheeler transform with its suffixes' numbers; neighbours[i]: suffixes i - 1 and i differ in ``depth`` symbols."""

    def __init__(self, suffixes: np.ndarray, bwt: np.ndarray, strings: int):
        self.suffixes, self.bwt, self.strings, self.parted = suffixes, bwt, strings, None


def merge(a: Merged, b: Merged, depth: int | None) -> Merged:
    """Refines the interleave of two transforms, for ``depth`` rounds or until nothing changes."""
    n, m = len(a.bwt) + len(b.bwt), a.strings + b.strings
    second = np.zeros(n, dtype=bool)
    second[len(a.bwt) :] = True
    group, parted = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
    symbol = np.empty(n, dtype=a.bwt.dtype)
    head = np.zeros(m, dtype=bool)
    head[a.strings :] = True
    count, rounds = 0, 0
    while depth is None or rounds < depth:
        symbol[~second] = a.bwt
        symbol[second] = b.bwt
        order = np.argsort(symbol, kind="stable")[m:]  # what follows an end is a whole string's suffix: ends come first, as they are
        s, g = symbol[order], group[order]
        parted[: m + 1] = True
        np.logical_or(s[1:] != s[:-1], g[1:] != g[:-1], out=parted[m + 1 :])
        refined = np.concatenate([head, second[order]])
        group = np.cumsum(parted, dtype=np.int32)
        same = count == group[-1] and np.array_equal(refined, second)
        second, count, rounds = refined, int(group[-1]), rounds + 1
        if same:
            break
    out = Merged(np.empty(n, dtype=np.int64), np.empty(n, dtype=a.bwt.dtype), m)
    out.suffixes[~second], out.suffixes[second] = a.suffixes, b.suffixes
    out.bwt[~second], out.bwt[second] = a.bwt, b.bwt
    out.parted = parted
    return out


def least_owner(contexts: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context and each window of ``length`` bytes in it, the least owner of a context with the same window."""
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.uint16
    code = np.zeros(256, dtype=kind)
    code[used] = np.arange(1, len(used) + 1)
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), dtype=kind)
    place = np.ones(len(symbols), dtype=bool)
    place[ends - 1] = False
    symbols[place] = code[data]
    # at least two shards, unless there is a single context
    shards = max(2, round(int(ends[-1]) / SHARD_BYTES))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1, shards) * (int(ends[-1]) / shards)), [len(contexts)]]))
    if len(cuts) == 2 and len(contexts) > 1:
        cuts = np.array([0, len(contexts) // 2, len(contexts)])
    level = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(ends[a] - sizes[a] - 1), int(ends[b - 1])
        suffixes, bwt = transform(symbols[lo:hi], int(b - a))
        level.append(Merged(suffixes + lo, bwt, int(b - a)))
    while len(level) > 1:
        last = len(level) == 2
        level = [merge(*level[i : i + 2], length if last else None) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    whole = level[0]
    string = np.repeat(np.arange(len(contexts)), sizes + 1)[whole.suffixes]
    if whole.parted is None:  # a single context
        least = owner[string]
    else:
        starts = np.flatnonzero(whole.parted)
        least = np.repeat(np.minimum.reduceat(owner[string], starts), np.diff(np.append(starts, len(string))))
    at_place = np.empty(len(symbols), dtype=np.int64)
    at_place[whole.suffixes] = least
    first = ends - sizes - 1
    return [at_place[f : f + max(0, s - length + 1)] for f, s in zip(first.tolist(), sizes.tolist(), strict=True)]


# ------------------------------------------------------------------------------------------------------ the job
def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (nulls last), text (null: empty), digest, key (of the digest) of each row."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("key", F.xxhash64("digest"))


def distinct_units(rows: DataFrame, n_rows: int, blocks: int) -> DataFrame:
    """block, key, doc, text, digest: each task's texts, once each; rows of later copies, with their least id, have no text."""
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("sender"))
    hot = rows.sparkSession.read.schema("digest binary, sender long").parquet(write_table(counts.where(F.col("n") > max(HOT_ROWS, HOT_SHARE * n_rows)).select("digest", "sender"), "repeats-hot"))
    sent = F.when(F.col("sender").isNull() | (F.col("sender") == F.col("doc")), F.col("text"))
    keyed = rows.join(F.broadcast(hot), "digest", "left").select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "key", "doc", sent.alias("text"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}  # of texts of this task: key, block, id sent, least id
        told: set[bytes] = set()  # whose text has been sent
        schema = None
        for b in batches:
            schema = b.schema
            first = np.zeros(b.num_rows, dtype=bool)
            texts = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            for i, (block, key, doc, digest) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)):
                at = known.setdefault(digest, [block, key, NO_ID, NO_ID])
                at[3] = min(at[3], doc)
                if texts[i] and digest not in told:
                    told.add(digest)
                    first[i], at[2] = True, doc
            yield b.filter(pa.array(first))
        rest = [(block, key, least, None, digest) for digest, (block, key, sent, least) in known.items() if least < sent or digest not in told]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rest, strict=True), schema, strict=True)], schema=schema)

    return keyed.mapInArrow(run, keyed.schema)


def packed_hashes(h: np.ndarray) -> np.ndarray:
    """Numbers of 48 bits as rows of six bytes."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def unpacked_hashes(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def spread_hash(h: np.ndarray) -> np.ndarray:
    return mixed(h + np.uint64(7))


def send_anchors(units: DataFrame, length: int, n_buckets: int, blocks: int) -> DataFrame:
    """bucket, hashes, keys: of each task's anchors two texts at most; block, marks: its other texts of such anchors."""

    def combined(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, k = (np.concatenate(x) for x in zip(*held, strict=True))
        h, k = distinct_pairs(h, k)
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        few = nth < 2
        rows = [(b, *x, None, None) for b, x in by_bucket(spread_hash(h[few]), [packed_hashes(h[few]), k[few]], n_buckets)]
        rows += [(b % n_buckets, None, None, b, x) for b, x in by_block(marks_of(k[~few], h[~few]), k[~few], blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["bucket", "hashes", "keys", "block", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 3, PART_BYTES):
                data, offsets = text_bytes_of(part.column(3))
                h, text, _, _ = anchors(data, offsets, length)
                held.append((h, part.column(1).to_numpy()[text]))
                n += len(h)
                if n > HELD_ANCHORS:
                    yield from combined(held)
                    held, n = [], 0
        if n:
            yield from combined(held)

    return units.mapInArrow(run, "bucket int, hashes binary, keys binary, block int, marks binary")


def distinct_pairs(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order of h, then k."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    once = np.ones(len(h), dtype=bool)
    once[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    return h[once], k[once]


def by_block(marks: np.ndarray, keys: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    block = np.mod(keys, blocks)
    by = np.argsort(block, kind="stable")
    marks, block = marks[by], block[by]
    cuts = np.flatnonzero(np.diff(block, prepend=-1, append=blocks))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(block[a]), marks[a:b].tobytes()


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The rows' columns after the first, for each value of the first."""
    held: dict[int, list[list]] = {}
    for batch in batches:
        for first, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(first, []).append(rest)
    while held:
        yield [list(x) for x in zip(*held.popitem()[1], strict=True)]


def shared_anchors(sent: DataFrame, n_buckets: int, blocks: int) -> DataFrame:
    """block, marks: for the texts of each block, text and anchor mixed into one number, of anchors that several texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            marked = batch.filter(batch.column(4).is_valid())
            if marked.num_rows:
                yield marked.select(["block", "marks"])
            for bucket, hashes, keys in zip(*(c.to_pylist() for c in batch.filter(batch.column(1).is_valid()).columns[:3]), strict=True):
                held.setdefault(bucket, []).append((hashes, keys))
        while held:
            hashes, keys = zip(*held.popitem()[1], strict=True)
            h, k = distinct_pairs(unpacked_hashes(b"".join(hashes)), np.frombuffer(b"".join(keys), "<i8"))
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(h)))
            many = np.repeat(times, times) > 1
            rows = list(by_block(marks_of(k[many], h[many]), k[many], blocks))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary()))], ["block", "marks"])

    return sent.repartition(n_buckets, "bucket").mapInArrow(run, "block int, marks binary")


def marks_of(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(keys.astype("<i8").view(np.uint64) + mixed(h))


#: What a context's text is: its place among the block's texts, and the first window's place in it.
WHERE = np.dtype([("unit", "<u4"), ("at", "<u4")])


def block_units(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """The block's distinct texts in an order that rows can't change, and the least id of each."""
    least = table.group_by("digest").aggregate([("doc", "min")]).sort_by("digest")
    table = table.filter(table["text"].is_valid()).sort_by("digest").combine_chunks()
    names = table["digest"].to_pylist()
    first = [i == 0 or names[i] != names[i - 1] for i in range(len(names))]
    batches = table.filter(pa.array(first, pa.bool_())).combine_chunks().to_batches()
    batch = batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)
    return batch, least["doc_min"].to_numpy()


def send_contexts(units: DataFrame, marks: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """bucket, block, anchors, contexts, sizes, where, docs: of each block, by the bucket of the anchor; and bucket, block,
    where, masks: what the block itself knows to repeat. Of equal contexts those of the least id go on; all windows of
    the others stand in a smaller document."""
    most = 2 * length - K

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            known = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in right["marks"]]))
            batch, docs = block_units(left)
            block, done, held = left["block"][0].as_py(), 0, []
            for part in slices(batch, 3, PART_BYTES):
                data, offsets = text_bytes_of(part.column(3))
                h, text, first, last = anchors(data, offsets, length)
                keep = find_in(known, marks_of(part.column(1).to_numpy()[text], h)) >= 0
                h, text, first, last = h[keep], text[keep], first[keep], last[keep]
                if len(h):
                    sizes = (last - first + length).astype(np.uint8)
                    wide = np.append(data, np.zeros(most, np.uint8))[first[:, None] + np.arange(most)]
                    wide[np.arange(most)[None, :] >= sizes[:, None]] = 0
                    where = np.empty(len(h), dtype=WHERE)
                    where["unit"], where["at"] = text + done, first - offsets[text]
                    held.append((h, wide, sizes, where, docs[text + done]))
                done += part.num_rows
            if held:
                h, wide, sizes, where, docs = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                name = row_hashes(wide)
                order = np.lexsort((docs, name, h))  # equal contexts next to each other, which compress too
                new = np.ones(len(order), dtype=bool)
                new[1:] = (h[order[1:]] != h[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                again = np.flatnonzero(~new & (docs[order] > docs[head]))
                again = again[(wide[order[again]] == wide[head[again]]).all(axis=1) & (sizes[order[again]] == sizes[head[again]])]
                if len(again):
                    own = order[again]
                    out.append((0, block, None, None, None, where[own].tobytes(), None, all_windows(sizes[own], length).tobytes()))
                order = np.delete(order, again)
                h = h[order]
                out += [(b, block, *x, None) for b, x in by_bucket(spread_hash(h), [packed_hashes(h), *(x[order] for x in (wide, sizes, where, docs))], n_buckets)]
        kinds = {"bucket": pa.int32(), "block": pa.int32(), "anchors": pa.binary(), "contexts": pa.binary(), "sizes": pa.binary(), "where_": pa.binary(), "docs": pa.binary(), "masks": pa.binary()}
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds.values())], names=list(kinds))

    schema = "bucket int, block int, anchors binary, contexts binary, sizes binary, where_ binary, docs binary, masks binary"
    return units.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, schema)


def row_hashes(wide: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    padded = np.zeros((len(wide), -(-wide.shape[1] // 8) * 8), np.uint8)
    padded[:, : wide.shape[1]] = wide
    out = np.zeros(len(wide), dtype=np.uint64)
    for column in padded.view("<u8").T:
        out = mixed(out * np.uint64(BASE) + column)
    return out


def all_windows(sizes: np.ndarray, length: int) -> np.ndarray:
    """The mask of a context of which all windows repeat."""
    return ((np.uint64(1) << (sizes.astype(np.int64) - length + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def halves(wide: np.ndarray, size: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in two: of each half its context, its first window there, a hash of its core, its bytes and their number.

    Windows that begin near their anchor all hold what follows it as well, the others what precedes it: a core of some
    ``(length + K) / 2`` bytes about the anchor. Equal windows have their anchor at one place, so they have equal cores; an
    anchor with very many contexts falls apart into cores with few. The anchor is where its hash is first met."""
    n, most = wide.shape
    middle = (length - K) // 2
    member, shift, core, part, sizes = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.uint64)], [np.empty((0, length + middle), np.uint8)], [np.empty(0, np.uint8)]
    step = max(1, PART_BYTES // 8 // most)  # beside the contexts, so less than where texts are read
    for begin in range(0, n, step):
        own, last = wide[begin : begin + step], size[begin : begin + step].astype(np.int64) - length
        padded = np.concatenate([own, np.zeros((len(own), length + middle), np.uint8)], axis=1)
        flat = window_hashes(np.append(own.ravel(), np.zeros(K - 1, np.uint8)), K) >> np.uint64(16)
        place = (flat.reshape(-1, most)[:, : most - length + 1] == h[begin : begin + len(own), None]).argmax(axis=1)
        for side, first, end, at, width in ((0, np.maximum(place - middle, 0), np.minimum(place, last), place, length - middle), (1, np.zeros_like(place), np.minimum(place - middle - 1, last), place - middle - 1, K + middle + 1)):
            k = np.flatnonzero(first <= end)
            cores = padded[k[:, None], at[k, None] + np.arange(width)]
            n_bytes = end[k] - first[k] + length
            found = padded[k[:, None], first[k, None] + np.arange(length + middle)]
            found[np.arange(length + middle)[None, :] >= n_bytes[:, None]] = 0
            for x, y in zip((member, shift, core, part, sizes), (k + begin, first[k].astype(np.uint32), mixed(row_hashes(cores) + np.uint64(side)), found, n_bytes.astype(np.uint8)), strict=True):
                x.append(y)
    return tuple(np.concatenate(x) for x in (member, shift, core, part, sizes))


def collapsed(core: np.ndarray, part: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each half the distinct one that it is a copy of; of these, by core, a row and the least document."""
    name = mixed(row_hashes(part) + size)
    order = np.lexsort((name, core))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (core[order[1:]] != core[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    run = np.cumsum(new) - 1
    unlike = np.zeros(len(order), dtype=bool)
    for begin in range(0, len(order), 1 << 15):
        one, other = order[begin : begin + (1 << 15)], head[begin : begin + (1 << 15)]
        unlike[begin : begin + (1 << 15)] = (part[one] != part[other]).any(axis=1) | (size[one] != size[other])
    new |= np.isin(run, run[unlike])  # where two of one hash differ, each stays by itself
    sub = np.empty(len(order), dtype=np.int64)
    sub[order] = np.cumsum(new) - 1
    heads = order[new]
    least = np.full(len(heads), NO_ID, dtype=np.int64)
    np.minimum.at(least, sub, doc)
    return sub, heads, least


def repeats(contexts: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """block, where_, masks: of each context with a window that a smaller document has; bit r is the window r after the first."""
    most = 2 * length - K

    def known(batches: Iterator[pa.RecordBatch], out: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column(7).is_valid()
            out.append(batch.filter(alone).select(["block", "where_", "masks"]))
            yield batch.filter(pc.invert(alone)).select(["bucket", "block", "anchors", "contexts", "sizes", "where_", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        groups = gather(known(batches, passed))
        first = next(groups, None)  # by now all rows have come
        yield from passed
        passed.clear()
        for blocks, anchors_, wides, sizes, where, docs in chain([] if first is None else [first], groups):
            counts = [len(x) for x in sizes]
            block = np.repeat(np.array(blocks, dtype=np.int32), counts)
            h = unpacked_hashes(b"".join(anchors_))
            wide = np.frombuffer(b"".join(wides), np.uint8).reshape(-1, most)
            size, doc = np.frombuffer(b"".join(sizes), np.uint8), np.frombuffer(b"".join(docs), "<i8")
            at = np.frombuffer(b"".join(where), WHERE)
            member, shift, core, part, part_size = halves(wide, size, h, length)
            del wide, wides
            sub, heads, least = collapsed(core, part, part_size, doc[member])
            mask = np.zeros(len(doc), dtype=np.uint32)
            # a half alone with its core shares its windows with its copies only: all are its least owner's
            core = core[heads]
            new = np.append(True, core[1:] != core[:-1]) if len(core) else np.empty(0, bool)
            first_of = np.flatnonzero(new)
            together = np.diff(np.append(first_of, len(core)))
            alone = np.repeat(together, together) == 1
            own = np.flatnonzero(alone[sub] & (least[sub] < doc[member]))
            np.bitwise_or.at(mask, member[own], all_windows(part_size[own], length) << shift[own])
            # the others, by the rank of what they are a copy of
            rank, left = np.cumsum(~alone) - 1, np.flatnonzero(~alone)
            entry = np.flatnonzero(~alone[sub])
            entry = entry[np.argsort(rank[sub[entry]], kind="stable")]
            among = rank[sub[entry]]
            part, core, own_size, least = part[heads[left]], core[left], part_size[heads[left]].astype(np.int64), least[left]
            # groups end where a core does
            sums, starts = np.cumsum(own_size + 1), np.flatnonzero(np.append(True, core[1:] != core[:-1])) if len(left) else []
            cut = 0
            while cut < len(left):
                goal = np.searchsorted(sums, (sums[cut - 1] if cut else 0) + GROUP_BYTES)
                i = np.searchsorted(starts, max(goal, cut + 1))
                end = int(starts[i]) if i < len(starts) else len(left)
                found = least_owner([part[r, : own_size[r]].tobytes() for r in range(cut, end)], least[cut:end], length)
                lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                windows = np.full((end - cut, part.shape[1] - length + 1), NO_ID, dtype=np.int64)
                windows[np.arange(windows.shape[1])[None, :] < lengths[:, None]] = np.concatenate(found)
                lo, hi = np.searchsorted(among, [cut, end])
                own = entry[lo:hi]
                smaller = windows[among[lo:hi] - cut] < doc[member[own]][:, None]
                bits = (smaller * (np.uint32(1) << np.arange(smaller.shape[1], dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
                np.bitwise_or.at(mask, member[own], bits << shift[own])
                cut = end
            hit = np.flatnonzero(mask)
            hit = hit[np.argsort(block[hit], kind="stable")]
            cuts = np.flatnonzero(np.diff(block[hit].astype(np.int64), prepend=-1, append=-2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[hit][cuts[:-1]], pa.int32())] + [pa.array([x[hit[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (at, mask)],
                ["block", "where_", "masks"],
            )
            del member, shift, core, part
            trim()

    return contexts.repartition(n_buckets, "bucket").mapInArrow(run, "block int, where_ binary, masks binary")


FOUND = {"digest": pa.binary(), "doc": pa.int64(), "text_size": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def cover(units: DataFrame, found: DataFrame, length: int, keep_bytes: bool) -> DataFrame:
    """For each distinct text: digest, doc, text_size, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in FOUND]
        if left.num_rows:
            batch, docs = block_units(left)
            where = np.concatenate([np.empty(0, WHERE), *(np.frombuffer(x.as_buffer(), WHERE) for x in right["where_"])])
            masks = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x.as_buffer(), "<u4") for x in right["masks"])])
            order = np.argsort(where["unit"], kind="stable")
            where, masks, done = where[order], masks[order], 0
            for part in slices(batch, 3, PART_BYTES):
                data, offsets = text_bytes_of(part.column(3))
                a, b = np.searchsorted(where["unit"], [done, done + part.num_rows])
                row, bit = np.nonzero(masks[a:b, None] >> np.arange(length - K + 1, dtype=np.uint32) & 1)
                at = where[a:b][row]
                begin = offsets[at["unit"] - done] + at["at"] + bit
                depth = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + length, minlength=len(data) + 1)
                gone = np.cumsum(depth)[: len(data)] > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < offsets[1:]]
                edge[heads] = gone[heads]
                removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge))
                raw = data.tobytes()
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    n = int(removed[hi] - removed[lo])
                    kept = data[lo:hi][~gone[lo:hi]].tobytes() if n else raw[lo:hi]
                    values = (part.column(4)[i].as_py(), int(docs[done + i]), hi - lo, n, int(spans[hi] - spans[lo]), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                done += part.num_rows
        return pa.table([pa.array(c, t) for c, t in zip(columns, FOUND.values(), strict=True)], names=list(FOUND))

    return units.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "digest binary, doc long, text_size long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for each row.

    * A byte goes if a string of ``length`` bytes that covers it starts in a document of smaller id as well.
    * Null texts count as empty, very long ones are read whole; texts of fewer than ``length`` bytes lose nothing. Spans can cut characters in two.
    * Null ids count as larger than all others. Rows of one id are not smaller than each other, so repeated rows and
      different texts of one id don't remove each other's bytes.
    * No rows in, no rows out. Only the two columns named are read.
    """
    if not K < length <= K + 31:  # windows of a context are bits of a number
        raise ValueError(f"length must be from {K + 1} to {K + 31}")
    n_rows, n_bytes = text_bytes(df, text_col)
    blocks, buckets = buckets_for(n_bytes), buckets_for(n_bytes)
    units = distinct_units(digests(df, id_col, text_col), n_rows, blocks)
    marks = shared_anchors(send_anchors(units, length, buckets, blocks), buckets, blocks)
    fine = buckets_for(2 * n_bytes)  # contexts are several times the text that repeats
    found = repeats(send_contexts(units, marks, length, fine), length, fine)
    by_text = cover(units, found, length, keep_bytes)
    empty = F.sha2(F.lit(""), 256)
    met = df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")).join(by_text, "digest")
    first = F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")
    whole = ~first & (F.col("text_size") >= length)
    out = met.select(
        "doc_id",
        F.col("text_size").alias("n_bytes"),
        F.when(whole, F.col("text_size")).when(first, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).when(first, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if keep_bytes else out.drop("kept")
