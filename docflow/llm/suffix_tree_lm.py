"""Language-model scores by a probabilistic suffix tree over words.

The root of the tree is the smoothed distribution of single words, from exact counts of all training words. States are
contexts of one to ``depth`` words, in two parts:

* Heavy contexts have a share of the training tokens of ``least_state`` at least, so there are at most depth /
  least_state of them; each keeps the followers whose joint share is at least ``least_pair`` (at most 1 / least_pair at
  each depth). This part is broadcast: its size is bounded by the two shares.
* Light contexts are all others of ``depth`` words, and of fewer too with ``every_length``. They keep each follower counted
  ``least_times`` times, whatever its share, so their number grows with the corpus. They stay in buckets: each token goes
  to its shortest light context's bucket, which counts followers, makes the states and sends back what they change in
  each text's score. A heavy context never goes there, so no bucket gets more than a bounded share through one context. Followers are common words (share of
  ``least_pair`` or more) and, as one symbol, all others; within that symbol words keep their parts.

Kept followers are discounted, and the rest of a state's mass goes to its parent, the longest suffix that is retained:

    P(w | s) = max(c(s, w) - discount, 0) / c(s) + rest(s) P(w | parent(s)),   c(s, w) = 0 unless kept

A state is retained if its distribution diverges from its parent's by ``divergence`` nats at least, the followers that
aren't kept taken together. A text is scored by the longest retained suffix of what precedes each word; the
probabilities of all words and the end sum to at most one in each state.

Counts of words are summed in buckets too, and aren't bounded. What a text's words other than common ones add is a sum
over their counts, made where the counts are. Both kinds of sums come back to the part of the input they are from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import buckets_for, drop_table, text_bytes, trim, write_table
from docflow.llm.words import mixed, powers, slices, word_hashes

#: The end of a text, as a word.
END = np.uint64(0x5BF0_3635_D7A5_1E07)
ALPHA = 0.1
#: Distinct keys that a task counts before it sorts them together.
GATHERED = 3_000_000
#: Tokens that a task gathers before it sends them to buckets.
SENT = 1_500_000
#: Entries from which bytes of one place are compressed by themselves.
ALONE = 1_000
#: Bits of a row's number that are its place in its part of the input.
PLACE_BITS = 38


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words followed by its end, and the number of the text of each."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts + 1)
    out = np.full(len(words) + len(counts), END, dtype=np.uint64)
    is_word = np.ones(len(out), dtype=bool)
    is_word[ends - 1] = False
    out[is_word] = words
    return out, np.repeat(np.arange(len(counts)), counts + 1)


class Counter:
    """Sums counts of 64-bit keys; holds each key once, and not many more keys than GATHERED."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > GATHERED:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts = [keys], [counts]
        # what stays after sorting doesn't count again until as much has come
        self.held = 0
        return keys, counts


def runs_of(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each of n buckets that has any of the (mixed) keys, and their places."""
    bucket = (keys >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=n))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        yield int(bucket[at[0]]), at


def by_bucket(keys: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' bytes for each bucket that has any of the (mixed) keys."""
    for bucket, at in runs_of(keys, n):
        yield bucket, [c[at].tobytes() for c in columns]


def folded(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed; bytes of one place stand together, since high bytes hardly vary, and of long
    columns they are compressed by themselves."""
    planes = [x for c in columns for x in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize * (c.shape[1] if c.ndim > 1 else 1)).T]
    compress = zstandard.ZstdCompressor(level=1).compress
    if len(columns[0]) < ALONE:
        return b"\0" + compress(b"".join(x.tobytes() for x in planes))
    return b"\1" + joined([compress(x.tobytes()) for x in planes])


def unfolded(data: bytes, *types: str) -> list[np.ndarray]:
    """The columns that were folded, of these types; ``u3`` is read as 32 bits, ``u6`` as 64."""
    widths = [int(t[-1]) for t in types]
    expand = zstandard.ZstdDecompressor().decompress
    planes = expand(data[1:]) if data[0] == 0 else b"".join(map(expand, parted(data[1:])))
    planes = np.frombuffer(planes, np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for t, width in zip(types, widths, strict=True):
        read = {"u3": "<u4", "u6": "<u8"}.get(t, f"<{t}")
        wide = np.zeros((planes.shape[1], int(read[-1])), dtype=np.uint8)
        wide[:, :width] = planes[at : at + width].T
        out.append(wide.view(read)[:, 0])
        at += width
    return out


def joined(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def parted(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        yield data[at + 4 : end]
        at = end


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of whole numbers, a row each."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def scrambled(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(0x9E3779B97F4A7C15)


def counted(rows: DataFrame, keys_of, n_buckets: int) -> str:
    """Writes bucket, keys, counts, total: the counts of the training rows' keys. keys_of: tokens, text numbers to keys.

    ``rows`` has doc_id, text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            batch = batch.filter(batch.column(2))
            for part in slices(batch, 1):
                counter.add(keys_of(*tokens_of(part.column(1))))
        keys, counts = counter.result()
        for i in range(0, len(keys), GATHERED):
            k, c = keys[i : i + GATHERED], counts[i : i + GATHERED].astype("<i8")
            rows = [(b, *x, int(np.frombuffer(x[1], "<i8").sum())) for b, x in by_bucket(scrambled(k), [k, c], n_buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["bucket", "keys", "counts", "total"])

    return write_table(rows.mapInArrow(run, "bucket int, keys binary, counts binary, total long"), "lm-counts")


def summed(table: DataFrame, n_buckets: int, least: float) -> tuple[int, np.ndarray, np.ndarray]:
    """How many distinct keys there are, and the keys counted ``least`` times or more, in order, with their counts.

    The caller sees to it that these are few: their share of all counts is bounded from below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {}
        for batch in batches:
            for b, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found.setdefault(b, Counter()).add(np.frombuffer(k.as_buffer(), "<u8"), np.frombuffer(c.as_buffer(), "<i8"))
        for counter in found.values():
            keys, counts = counter.result()
            keep = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([keys[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())], ["distinct", "keys", "counts"])

    rows = table.select("bucket", "keys", "counts").repartition(n_buckets, "bucket").mapInArrow(run, "distinct long, keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in rows), "<u8")
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<i8")
    order = np.argsort(keys)
    return sum(r["distinct"] for r in rows), keys[order], counts[order]


def find_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Level:
    """States of one depth. A state's key is its parent context's number times the number of common words, plus its
    first word: numbers count candidates of the depth before (at depth 1 there is one context, the empty one)."""

    keys: np.ndarray  # of the candidates, sorted
    retained: np.ndarray
    rest: np.ndarray  # the mass left to the parent
    pairs: np.ndarray  # candidate's number times the number of common words, plus the follower's; sorted
    mass: np.ndarray  # of each pair
    times: np.ndarray  # the pair was counted


@dataclass
class Tree:
    common: np.ndarray  # hashes of the common words, sorted
    counts: np.ndarray
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    def root(self, count: np.ndarray | float) -> np.ndarray:
        return (count + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1))

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Common words' places by falling count, and the words in that order; the numbers behind them stay."""
        words = np.append(np.argsort(-self.counts, kind="stable"), [len(self.common), len(self.common) + 1])
        return np.argsort(words), words

    def heavy(self, before: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The heavy part's probability of each word after the words ``before`` it (the last one first), and how many of
        these the longest heavy context has. Numbers from that of common words on are no common words; as ``word`` they
        are all such words together."""
        size = len(self.common)
        other = word >= size
        p = np.full(len(word), 1 - self.root(self.counts).sum())
        p[~other] = self.root(self.counts[word[~other]])
        state, length = np.zeros(len(word), dtype=np.int64), np.zeros(len(word), dtype=np.int64)
        for level, first in zip(self.levels, before, strict=False):
            has = (state >= 0) & (first < size)
            state = np.where(has, find_in(level.keys, np.where(has, state * size + first, -1)), -1)
            has = state >= 0
            length += has
            at = find_in(level.pairs, np.where(has & ~other, state * size + word, -1))
            p = np.where(has, level.rest[np.maximum(state, 0)], 1.0) * p
            if len(level.mass):
                p += np.where(at >= 0, level.mass[np.maximum(at, 0)], 0.0)
        return p, length

    def contexts(self, word: np.ndarray, text: np.ndarray, depth: int) -> np.ndarray:
        """The candidate of this depth (number, or -1) that precedes each token; word: numbers of common words or -1."""
        n = len(word)
        state = np.zeros(n, dtype=np.int64)
        for d in range(1, depth + 1):
            level = self.levels[d - 1]
            first = np.full(n, -1, dtype=np.int64)  # the word d places before
            if n > d:
                first[d:] = np.where(text[d:] == text[:-d], word[:-d], -1)
            ok = (state >= 0) & (first >= 0)
            state = np.where(ok, find_in(level.keys, np.where(ok, state * len(self.common) + first, -1).astype(np.int64)), -1)
        return state


def train_tree(rows: DataFrame, n_bytes: int, depth: int, least_state: float, least_pair: float, divergence: float, discount: float) -> Tree:
    spark = rows.sparkSession
    n_buckets = buckets_for(n_bytes / 2)
    path = counted(rows, lambda tokens, text: tokens, n_buckets)
    words = spark.read.parquet(path)
    tokens = int(words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"])
    distinct, common, counts = summed(words, n_buckets, max(1, least_pair * tokens))
    drop_table(spark, path)
    tree = Tree(common, counts, tokens, distinct)
    size = len(common)
    for d in range(1, depth + 1):
        if not size:
            break
        least = max(2, least_state * tokens)
        if d == 1:
            keys = np.flatnonzero((counts >= least) & (common != END)).astype(np.int64)
        else:  # contexts one word longer: a kept follower of a candidate, seen from its last word
            keys = longer_contexts(tree, d, least)
        if not len(keys):
            break
        n = len(keys)
        tree.levels.append(Level(keys, np.zeros(n, bool), np.ones(n), np.empty(0, np.int64), np.empty(0), np.empty(0)))
        sent = spark.sparkContext.broadcast(tree)

        def pair_keys(tokens: np.ndarray, text: np.ndarray, d: int = d) -> np.ndarray:
            """Context and follower where both are kept, and context and ``size`` for any follower."""
            t = sent.value
            word = find_in(t.common, tokens)
            state = t.contexts(word, text, d)
            at, wide = state >= 0, np.int64(len(t.common) + 1)
            both = at & (word >= 0)
            return np.concatenate([state[both] * wide + word[both], state[at] * wide + len(t.common)]).astype(np.uint64)

        path = counted(rows, pair_keys, n_buckets)
        found = spark.read.parquet(path)
        # totals of candidates and pairs of the least share: both bounded
        _, pairs, times = summed(found, n_buckets, max(2, least_pair * tokens))
        drop_table(spark, path)
        sent.destroy()
        tree.levels[-1] = level_of(tree, d, keys, pairs.astype(np.int64), times, divergence, discount)
    return tree


def longer_contexts(tree: Tree, d: int, least: float) -> np.ndarray:
    """Keys of candidates of depth d: (w1 .. wd) such that wd is a kept follower of (w1 .. wd-1), least times or more,
    and (w2 .. wd) is a candidate. For depth 2: key of (w1, w2) is number of (w2) times the words, plus w1."""
    size, level = len(tree.common), tree.levels[d - 2]
    state, last = level.pairs // size, level.pairs % size
    often = level.times >= least
    state, last = state[often], last[often]
    # the words of each candidate, last word first
    spelled = spell(tree, d - 1)[state]
    number = find_in(tree.levels[0].keys, last)
    for k in range(d - 2):
        number = np.where(number >= 0, find_in(tree.levels[k + 1].keys, number * size + spelled[:, k]), -1)
    ok = number >= 0
    return np.unique(number[ok] * size + spelled[ok, d - 2])


def spell(tree: Tree, d: int) -> np.ndarray:
    """The words of each candidate of depth d, the last one first."""
    size = len(tree.common)
    number, columns = np.arange(len(tree.levels[d - 1].keys)), []
    for k in range(d, 0, -1):
        key = tree.levels[k - 1].keys[number]
        columns.append(key % size)
        number = key // size
    return np.stack(columns[::-1], axis=1)


def level_of(tree: Tree, d: int, keys: np.ndarray, pairs: np.ndarray, times: np.ndarray, divergence: float, discount: float) -> Level:
    """Discounts, and tests each candidate's divergence from its parent."""
    size, n = len(tree.common), len(keys)
    state, word = pairs // (size + 1), pairs % (size + 1)
    total = np.zeros(n)
    total[state[word == size]] = times[word == size]
    kept = word < size
    state, word, times = state[kept], word[kept], times[kept]
    mass = (times - discount) / np.maximum(total[state], 1)
    rest = 1 - np.bincount(state, mass, minlength=n)
    parent = parent_probability(tree, d, keys, state, word)
    p = mass + rest[state] * parent
    p_other = np.maximum(1 - np.bincount(state, p, minlength=n), 1e-12)
    q_other = np.maximum(1 - np.bincount(state, parent, minlength=n), 1e-12)
    gain = np.bincount(state, p * np.log(p / parent), minlength=n) + p_other * np.log(p_other / q_other)
    retained = (total > 0) & (gain >= divergence)
    return Level(keys, retained, np.where(retained, rest, 1.0), state * size + word, np.where(retained[state], mass, 0.0), times)


def parent_probability(tree: Tree, d: int, keys: np.ndarray, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """P(word | the parent of each state): through the retained suffixes, shortest first."""
    size = len(tree.common)
    p = tree.root(tree.counts[word])
    chain, number = [], keys // size  # numbers of the suffixes, the longest first
    for k in range(d - 1, 0, -1):
        chain.append((k, number))
        number = tree.levels[k - 1].keys[number] // size
    for k, number in reversed(chain):
        level, own = tree.levels[k - 1], number[state]
        at = find_in(level.pairs, own * size + word)
        p = level.rest[own] * p + np.where(at >= 0, level.mass[np.maximum(at, 0)] if len(level.mass) else 0.0, 0.0)
    return p


def score_tokens(tree: Tree, tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's base and heavy probability (without what the counts of other than common words add), its number (-1:
    not a common word) and how many words the longest heavy context before it has."""
    word = find_in(tree.common, tokens)
    other = word < 0
    own = tree.root(tree.counts[np.maximum(word, 0)]) if len(tree.counts) else np.ones(len(word))
    base = np.where(other, tree.root(1 - ALPHA), own)
    p, length = base.copy(), np.zeros(len(word), dtype=np.int64)
    size = len(tree.common)
    for d, level in enumerate(tree.levels, 1):
        state = tree.contexts(word, text, d)
        has = state >= 0
        length += has
        at = find_in(level.pairs, np.where(has & ~other, state * size + word, -1))
        p = np.where(has, level.rest[np.maximum(state, 0)], 1.0) * p
        if len(level.mass):
            p += np.where(at >= 0, level.mass[np.maximum(at, 0)], 0.0)
    return base, p, word, length


def light_contexts(tokens: np.ndarray, word: np.ndarray, text: np.ndarray, length: np.ndarray, depth: int, every_length: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places of the tokens that light contexts precede, and a hash of the shortest of these: of one word more than
    the longest heavy context, or else of ``depth`` words."""
    n = len(tokens)
    least = np.minimum(length + 1, depth) if every_length else np.full(n, depth)
    back = np.arange(n) - least
    ok = (length < depth) & (back >= 0)
    ok &= text[np.maximum(back, 0)] == text
    at = np.flatnonzero(ok)
    weights, key = powers(depth + 1), np.zeros(len(at), dtype=np.uint64)
    for d in range(1, depth + 1):
        part = least[at] >= d
        key[part] += tokens[at[part] - d] * weights[d]
    return at, mixed(key)


def words_before(at: np.ndarray, tokens: np.ndarray, word: np.ndarray, text: np.ndarray, depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words 1 to ``depth`` places before, a row each (size: not a common word; size + 1: not in the
    text), and their hashes."""
    numbers, hashes = np.full((depth, len(at)), size + 1, dtype=np.int64), np.zeros((depth, len(at)), dtype=np.uint64)
    for d in range(1, depth + 1):
        ok = at >= d
        ok[ok] = text[at[ok] - d] == text[at[ok]]
        own = word[at[ok] - d]
        numbers[d - 1, ok], hashes[d - 1, ok] = np.where(own < 0, size, own), tokens[at[ok] - d]
    return numbers, hashes


def light_states(tree: Tree, before: np.ndarray, hashes: np.ndarray, follower: np.ndarray, train: np.ndarray, every_length: bool, **options) -> np.ndarray:
    """What the light states of the tokens' contexts add to log10 of their probabilities, shorter contexts first. A bucket
    has all tokens of each context."""
    depth, size = len(before), len(tree.common)
    lower, length = tree.heavy(list(before), follower)
    added, key, weights = np.zeros(len(follower)), np.zeros(len(follower), dtype=np.uint64), powers(depth + 1)
    for d in range(1, depth + 1):
        own = before[d - 1]
        key += np.where(own == size, hashes[d - 1] << np.uint64(16), mixed(own.astype(np.uint64) + np.uint64(1)) | np.uint64(1)) * weights[d]
        at = np.flatnonzero((own <= size) & ((length < d) if every_length else (d == depth)))
        gains = light_gains(mixed(key[at]), follower[at], lower[at], train[at], **options)
        added[at] += gains
        lower[at] *= 10.0**gains
    return added


def light_gains(key: np.ndarray, follower: np.ndarray, lower: np.ndarray, train: np.ndarray, least_times: int, divergence: float, discount: float) -> np.ndarray:
    """What the state of each token's context adds to log10 of its probability, which is ``lower`` in the parent."""
    if not len(key):
        return np.empty(0)
    order = np.lexsort((follower, key))
    k, f = key[order], follower[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_pair = new_key | np.concatenate([[True], f[1:] != f[:-1]])
    pair, heads = np.cumsum(new_pair) - 1, np.flatnonzero(new_pair)
    state = (np.cumsum(new_key) - 1)[heads]
    times = np.bincount(pair, train[order])
    total = np.bincount(state, times)
    low = lower[order][heads]
    kept = times >= least_times
    mass = np.where(kept, (times - discount) / np.maximum(total[state], 1), 0.0)
    rest = 1 - np.bincount(state, mass)
    p = mass + rest[state] * low
    p_other = np.maximum(1 - np.bincount(state, p * kept), 1e-12)
    low_other = np.maximum(1 - np.bincount(state, low * kept), 1e-12)
    gain = np.bincount(state, np.where(kept, p * np.log(p / low), 0.0)) + p_other * np.log(p_other / low_other)
    retained = (np.bincount(state, kept) > 0) & (gain >= divergence)
    out = np.empty(len(key))
    out[order] = np.where(retained[state], np.log10(p / low), 0.0)[pair]
    return out


#: Rows of texts have the first seven; rows for buckets the others, as folded columns: of other words their hashes and refs
#: (places from ``first`` on times two, plus one in training texts); of tokens the numbers of the words before and of the
#: follower by falling count, how far refs rise, and 48 bits of the hash of each word before that isn't common. Followers'
#: probabilities in the heavy part are made anew from the broadcast tree. What comes back is places in the part and sums, folded.
TEXT = "row long, doc_id long, train boolean, n_tokens long, n_common long, base double, score double"
SENT_ON = f"{TEXT}, bucket int, first long, packed binary"
BACK = f"{TEXT}, part long, added binary, gains binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def record(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the schema with these columns (Arrow arrays or lists); the others are null."""
    fields = [f.split() for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = [pa.nulls(n, _TYPES[t]) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], _TYPES[t]) for c, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in fields])


def sent_on(rows: DataFrame, sent: Broadcast, depth: int, every_length: bool, n_words: int, n_contexts: int) -> DataFrame:
    """A row for each text, rows of the other words for buckets 0 to n_words - 1, and of tokens after light contexts for the
    n_contexts buckets from there on. sent: the tree."""

    def flushed(first: int, words: list, contexts: list) -> Iterator[pa.RecordBatch]:
        keys, refs = (np.concatenate(x) for x in zip(*words, strict=True))
        packed = [(b, folded(keys[at], refs[at])) for b, at in runs_of(scrambled(keys), n_words)]
        if contexts:
            keys, numbers, hashes, refs = (np.concatenate(x, axis=-1) for x in zip(*contexts, strict=True))
            rare = len(sent.value.common)
            for b, at in runs_of(scrambled(keys), n_contexts):
                own = numbers[:, at]
                spelled = [folded(low_bytes(h[at][k == rare], 6)) for k, h in zip(own[1:], hashes, strict=True)]
                rises = np.diff(refs[at].astype(np.int64), prepend=0).astype("<u4")
                packed.append((b + n_words, joined([folded(*(low_bytes(k, 3) for k in own), rises), *spelled])))
        yield record(SENT_ON, bucket=[b for b, _ in packed], first=[first] * len(packed), packed=[x for _, x in packed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, first = sent.value, TaskContext.get().partitionId() << PLACE_BITS
        rank, _ = t.ranks()
        part, n_rows, held, words, contexts = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for some in slices(batch, 1):
                n = some.num_rows
                tokens, text = tokens_of(some.column(1))
                base, p, word, length = score_tokens(t, tokens, text)
                other = word < 0
                train = some.column(2).to_numpy(zero_copy_only=False)
                sums = {"base": np.bincount(text, np.log10(base), minlength=n), "score": np.bincount(text, np.log10(p), minlength=n)}
                counts = {"n_tokens": np.bincount(text, minlength=n), "n_common": np.bincount(text, ~other, minlength=n).astype(np.int64)}
                yield record(SENT_ON, row=first + n_rows + np.arange(n), doc_id=some.column(0), train=some.column(2), bucket=np.full(n, part % n_words, np.int32), **counts, **sums)
                refs = ((n_rows + text) * 2 + train[text]).astype("<u4")
                words.append((tokens[other], refs[other]))
                if depth:
                    at, keys = light_contexts(tokens, word, text, length, depth, every_length)
                    numbers, hashes = words_before(at, tokens, word, text, depth, len(t.common))
                    followers = np.where(other, len(t.common), word)[at]
                    contexts.append((keys, rank[np.vstack([followers, numbers])].astype("<u4"), hashes, refs[at]))
                n_rows, held = n_rows + n, held + len(tokens)
                if held >= SENT:
                    yield from flushed(first, words, contexts)
                    first, n_rows, held, words, contexts = first + n_rows, 0, 0, [], []
        if words:
            yield from flushed(first, words, contexts)
        trim()

    return rows.mapInArrow(run, SENT_ON)


OTHER = np.dtype([("word", "<u8"), ("row", "<i8"), ("train", "?")])


def back(table: DataFrame, sent: Broadcast, depth: int, every_length: bool, n_words: int, n_contexts: int, **options) -> DataFrame:
    """The texts' rows, and for each part of the input what the buckets add: log10(c + ALPHA) of other words, how many of
    them have c > 0, and the gains of light states."""

    def by_part(name: str, rows: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``rows`` are in order."""
        part = rows >> PLACE_BITS
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        places = (rows - (part << PLACE_BITS)).astype("<u4")
        yield record(BACK, part=part[cuts[:-1]], **{name: [folded(places[a:b], *(c[a:b] for c in columns)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    def words_of(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = []
        for first, data in parts:
            word, refs = unfolded(data, "u8", "u4")
            x = np.empty(len(refs), dtype=OTHER)
            x["word"], x["row"], x["train"] = word, first + (refs >> 1).astype(np.int64), (refs & 1).astype(bool)
            found.append(x)
        x = np.concatenate(found)
        words, inverse = np.unique(x["word"], return_inverse=True)
        count = np.bincount(inverse, x["train"], minlength=len(words))[inverse]
        rows, own = np.unique(x["row"], return_inverse=True)
        yield from by_part("added", rows, np.bincount(own, np.log10(count + ALPHA)), np.bincount(own, count > 0).astype("<u4"))

    def contexts_of(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        t, found = sent.value, []
        _, words = t.ranks()
        for first, data in parts:
            columns, *spelled = parted(data)
            *numbers, rises = unfolded(columns, *["u3"] * (depth + 1), "u4")
            numbers, refs = words[np.stack(numbers)], np.cumsum(rises, dtype=np.int64)
            hashes = np.zeros((depth, len(refs)), dtype=np.uint64)
            for k, some in enumerate(spelled):
                hashes[k, numbers[k + 1] == len(t.common)] = unfolded(some, "u6")[0]
            found.append((numbers.astype(np.int32), hashes, first + (refs >> 1), (refs & 1).astype(bool)))
        numbers, hashes, row, train = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
        del found
        follower, before = numbers[0].astype(np.int64), numbers[1:].astype(np.int64)
        gains = light_states(t, before, hashes, follower, train, every_length, **options)
        changed = gains != 0
        rows, own = np.unique(row[changed], return_inverse=True)
        if len(rows):
            yield from by_part("gains", rows, np.bincount(own, gains[changed]).astype("<f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        n_text = len(TEXT.split(", "))
        for batch in batches:
            is_text = batch.column(0).is_valid()
            texts = batch.filter(is_text)
            if texts.num_rows:
                columns = dict(zip(texts.schema.names[:n_text], texts.columns[:n_text], strict=True))
                yield record(BACK, part=texts.column(0).to_numpy() >> PLACE_BITS, **columns)
            packed = batch.filter(pa.compute.invert(is_text))
            for b, first, data in zip(*(packed.column(c).to_pylist() for c in ("bucket", "first", "packed")), strict=True):
                held.setdefault(b, []).append((first, data))
        while held:
            b, parts = held.popitem()
            yield from (words_of if b < n_words else contexts_of)(parts)
        trim()

    return table.repartition(n_words + n_contexts, "bucket").mapInArrow(run, BACK)


def gathered(table: DataFrame, n_parts: int) -> DataFrame:
    """The texts' rows, with what came back added: TEXT's columns, and added, known, gains."""
    schema = f"{TEXT}, added double, known long, gains double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[pa.RecordBatch]] = {}
        sums: dict[tuple[int, str], np.ndarray] = {}
        kinds = {"added": ("added", "known"), "gains": ("gains",)}
        types = {"added": ("u4", "f8", "u4"), "gains": ("u4", "f4")}
        n_text = len(TEXT.split(", "))
        for batch in batches:
            for part in np.unique(batch.column("part")).tolist():
                own = batch.filter(pa.compute.equal(batch.column("part"), part))
                rows = own.filter(own.column(0).is_valid())
                if rows.num_rows:
                    texts.setdefault(part, []).append(rows.select(rows.schema.names[:n_text]))
                for kind, names in kinds.items():
                    for data in own.column(kind).drop_null().to_pylist():
                        places, *values = unfolded(data, *types[kind])
                        at = places.astype(np.int64)
                        for name, x in zip(names, values, strict=True):
                            total = sums.get((part, name), np.zeros(0))
                            if at[-1] >= len(total):
                                total = np.concatenate([total, np.zeros(int(at[-1]) + 1)])
                            total[at] += x  # places of a record are distinct and in order
                            sums[part, name] = total
        for part, batches_ in texts.items():
            for rows in batches_:
                at = rows.column(0).to_numpy() - (part << PLACE_BITS)
                found = {}
                for name in ("added", "known", "gains"):
                    total = sums.get((part, name), np.zeros(0))
                    inside = at < len(total)
                    found[name] = np.where(inside, total[np.where(inside, at, 0)] if len(total) else 0.0, 0.0)
                found["known"] = found["known"].astype(np.int64)
                yield record(schema, **dict(zip(rows.schema.names, rows.columns, strict=True)), **found)

    return table.repartition(n_parts, "part").mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is divisible by 10. Null ids: not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_documents(df: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, least_state: float = 2e-5, least_pair: float = 4e-6, least_times: int = 2, divergence: float = 0.01, discount: float = 0.5, every_length: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    * ``every_length``: light contexts of one word up to ``depth`` words have states, not those of ``depth`` words only.
    * Null and empty texts have one token, the end. Rows of one id and repeated rows are scored (and learned from) each.
    * Without training rows every word is unknown: both scores are those of ALPHA over an empty count.
    * No rows in, no rows out. Only the two columns named, and those of ``held_out``, are read.
    """
    held_out = is_held_out(id_col) if held_out is None else held_out
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~held_out).alias("train"))
    _, n_bytes = text_bytes(rows)
    tree = train_tree(rows, n_bytes, depth, least_state, least_pair, divergence, discount)
    n_words, n_contexts = buckets_for(n_bytes / 3), buckets_for(n_bytes * 3)
    sent = df.sparkSession.sparkContext.broadcast(tree)
    table = back(sent_on(rows, sent, depth, every_length, n_words, n_contexts), sent, depth, every_length, n_words, n_contexts, least_times=least_times, divergence=divergence, discount=discount)
    table = gathered(table, n_words)
    return table.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_common") + F.col("known")).alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("added")).alias("base_score"),
        (F.col("score") + F.col("added") + F.col("gains")).alias("score"),
    )
