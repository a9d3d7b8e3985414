"""Words and word shingles of many texts at once, as 64-bit hashes, computed on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE = _VALUE[LOWER]
_VALUE[SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that sums of products spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text, one row at least."""
    sizes = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32, count=batch.num_rows + batch.column(column).offset + 1)[batch.column(column).offset :].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + n + 1)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (ASCII capitals lowered, parted by white space) and, for each text, how many words it has."""
    data, offsets = text_bytes_of(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    gaps = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data), dtype=np.int64) - np.repeat(at, gaps)
    terms = _VALUE[data[at[0] :]] * powers(int(gaps.max()))[place]
    found = mixed(np.add.reduceat(terms, at - at[0]))
    return found, np.diff(np.searchsorted(at, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``size`` words within a text; a text of fewer words gives one, of all of them."""
    ends = np.cumsum(counts)
    starts = ends - counts
    total = len(words)
    weight = powers(size + 1)
    sums = np.zeros(max(total - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        sums += words[k : k + len(sums)] * weight[k]
    owner = np.repeat(np.arange(len(counts)), counts)
    full = np.flatnonzero(owner[: len(sums)] == owner[size - 1 : size - 1 + len(sums)])
    hashes, texts = [mixed(sums[full])], [owner[full]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            part = np.zeros(len(short), dtype=np.uint64)
            for k in range(n):
                part += words[starts[short] + k] * weight[k]
            hashes.append(mixed(part ^ np.uint64(n)))
            texts.append(short)
    return np.concatenate(hashes), np.concatenate(texts)
