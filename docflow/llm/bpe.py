"""Byte-level BPE by merge replay over a block of documents.

Instead of merging each word on its own, the distinct words of a block (all documents that a task holds, up to
``block_bytes``) are laid out in one array of token ids. An inverted index leads from each mergeable token pair,
named by the rank of what it makes, to the positions where it stands; the ranks are taken in order from a heap, all
positions of a rank are merged at once, and just the pairs left and right of them are looked up anew. The result is the
same for any blocks, so blocks bound the memory and a lost task is simply run again.

As the tiktoken library does, a word that is itself a token gets that token; a merge whose product could join its
neighbours at a lower rank is done one position per word at a time, so that the lower rank goes first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.units import Numbers, units


class MergeReplay:
    """Encodes lists of words (as bytes) by the ranks of a tiktoken file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.tokens = {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, made, early = [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(rank)
                early.update(x for x in (left, right) if x is not None and x > rank)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int32)[order]
        #: Tokens that can be part of a token of lower rank.
        self.early = early

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, x in enumerate(out) if x is None and words[i]]
        for i, ids in zip(todo, self._replay([words[i] for i in todo]), strict=True):
            out[i] = ids
        return [[] if x is None else x for x in out]

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n, ends = int(lengths.sum()), np.cumsum(lengths)
        token = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int64)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[ends - lengths] = -1
        alive, rank = np.ones(n, dtype=bool), np.full(n, -1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            """Looks up the pairs that begin at these positions and adds them to the index."""
            has = after[positions] >= 0
            rank[positions[~has]] = -1
            positions = positions[has]
            found = self.rank_of(token[positions], token[after[positions]])
            rank[positions] = found
            positions, found = positions[found >= 0], found[found >= 0]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(found)) + 1])
            for r, a, b in zip(found[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(found)], strict=True):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(heap, r)

        enter(np.arange(n, dtype=np.int64))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = np.unique(at[rank[at] == r])
            if not len(at):
                continue
            if r in self.early and len(at) > 1:
                first = np.concatenate([[True], np.diff(word[at]) != 0])
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
            elif len(at) > 1:
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():  # x x x: the first two go together
                    i = np.arange(len(at))
                    at = at[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            gone = after[at]
            token[at], alive[gone], rank[gone] = r, False, -1
            beyond = after[gone]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            left = before[at]
            left = left[left >= 0]
            enter(np.unique(np.concatenate([at, left])) if len(left) else at)
        counts = np.bincount(word[alive], minlength=len(words))
        cuts, ids = np.concatenate([[0], np.cumsum(counts)]).tolist(), token[alive].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def replay_of(path: str) -> MergeReplay:
    """One per worker."""
    return MergeReplay.from_file(path)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> regex.Pattern:
    r"""White space is what Unicode says, as in tiktoken; the module's own \s has four control characters more."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode_block(texts: list[str], replay: MergeReplay, pattern: regex.Pattern) -> tuple[list[str], list[list[int]], list[list[int]]]:
    """The block's distinct words, their ids, and each text as numbers of words."""
    heads, tails = Numbers(), Numbers()
    rows = []
    for text in texts:
        parts = units(text) if text else []
        rows.append((heads[parts[0]] if parts else -1, np.fromiter(map(tails.__getitem__, parts[1:]), dtype=np.int32, count=max(len(parts) - 1, 0))))
    words = Numbers()
    of_head = [list(map(words.__getitem__, pattern.findall(x))) for x in heads]
    of_tail = [list(map(words.__getitem__, pattern.findall(" " + x))) for x in tails]
    ids = replay.encode([w.encode() for w in words])
    docs = [[*(of_head[h] if h >= 0 else ()), *chain.from_iterable(map(of_tail.__getitem__, t.tolist()))] for h, t in rows]
    return list(words), ids, docs


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text; null texts count as empty, which have no ids."""

    def blocks(texts: list[str]) -> pa.Array:
        replay = replay_of(path)
        _, ids, docs = encode_block(texts, replay, splitter(pattern))
        return pa.array([list(chain.from_iterable(map(ids.__getitem__, d))) for d in docs], type=pa.list_(pa.int32()))

    return _by_block(df, id_col, text_col, "ids array<int>", lambda texts: [blocks(texts)])


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes (binary) of the ids of each row; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([replay.decode(x or []) for x in b.column(1).to_pylist()], type=pa.binary())], ["doc_id", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text's ids and of the bytes that they decode to.

    * Null texts count as empty: no tokens, digests of the empty string. Null and repeated ids stay as they are.
    * Very long texts and words make a block larger than ``block_bytes`` but need no other care.
    * Other columns of ``df`` are not read.
    """

    def digests(texts: list[str]) -> list[pa.Array]:
        replay = replay_of(path)
        _, ids, docs = encode_block(texts, replay, splitter(pattern))
        written = [",".join(map(str, x)) for x in ids]
        back = [replay.decode(x) for x in ids]
        count = [len(x) for x in ids]
        sha = hashlib.sha256
        return [
            pa.array([sum(map(count.__getitem__, d)) for d in docs], type=pa.int64()),
            pa.array([sha(",".join(map(written.__getitem__, d)).encode()).hexdigest() for d in docs], type=pa.string()),
            pa.array([sha(b"".join(map(back.__getitem__, d))).hexdigest() for d in docs], type=pa.string()),
        ]

    return _by_block(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _by_block(df: DataFrame, id_col: str, text_col: str, schema: str, work, block_bytes: int = 24 << 20) -> DataFrame:
    """Applies ``work`` to the texts of blocks of rows; each block holds at least one row."""
    names = ["doc_id", *(x.split()[0] for x in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [x or "" for x in table.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), *work(texts)], names)

        for b in batches:
            step = max(1, int(b.num_rows * block_bytes / max(b.nbytes, block_bytes)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                if held and size + part.nbytes > block_bytes:
                    yield done()
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield done()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {schema}")
