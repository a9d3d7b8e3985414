"""The prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation is the sequence of its turns' digests (16 bytes of SHA-256 of role and text), so byte order is an order of
sequences. Splitters, taken from a sample, cut that order into parts. Each task sorts what it reads into runs; a run's
row carries its common prefix (LCP) with the row before and only the turns beyond it, so a shared turn is sent once a
run. A part's runs are merged by a loser tree whose players remember their LCP with the last winner: only where two LCPs
are equal are turns compared, from there on. The merged stream goes through a stack of open nodes: a node is finished
when a conversation leaves its path.

A node that lies in several parts is a prefix of a splitter, so there are at most as many as the splitters have turns.
Parts give such nodes as partial sums, which are added up and closed in the order of the splitters; all other nodes
are whole within their part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import drop_table, materialise, write_table

#: Bytes of a turn's digest.
TURN = 16
#: Bytes of paths in a part and in a run, about.
PART_BYTES = RUN_BYTES = 16 << 20
#: Paths that the splitters are chosen from, for each part and in all.
SAMPLE, SAMPLES = 30, 300_000
#: Ids of one digest's row in ``ends``.
ENDS = 100_000

RUN = "part int, run string, seq int, lcp int, rest binary, words array<int>, conv_id long"
NODE = "kind string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, owner int, words long, part int, piece int, ends string"
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# ---- sequences

def turns_of(df: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each with digest and words. Ties of one turn number are in order of the digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, 2 * TURN))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0)))
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), words.alias("w")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))  # nulls first within a struct


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def rebuilt(df: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, path, words: h turns of the family's first conversation, then the conversation's own after its first h,
    h below ``shared`` by the id's checksum."""
    own = turns_of(df)
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("head"))
    h = (unsigned_crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    met = own.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    turns = met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    joined = F.aggregate("turns", F.lit(b""), lambda a, t: F.concat(a, t["d"]))
    return turns.select("conv_id", joined.alias("path"), F.transform("turns", lambda t: t["w"]).alias("words"))


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share from the first; ``known`` of them are known."""
    at, most = known * TURN, min(len(a), len(b))
    while at < most and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


# ---- runs

@dataclass(frozen=True)
class Splitters:
    """Keys (path, conv_id) where parts begin, but for the first part. A prefix of a splitter is named by the first
    splitter that has it (its owner) and its depth; the root by (0, 0)."""

    keys: list[tuple[bytes, int]]
    owners: list[list[int]]

    @staticmethod
    def of(keys: list[tuple[bytes, int]]) -> Splitters:
        owners: list[list[int]] = []
        for j, (path, _) in enumerate(keys):
            same = common_turns(keys[j - 1][0], path) if j else -1
            owners.append((owners[-1][: same + 1] if j else [0]) + [j] * (len(path) // TURN - max(same, 0)))
        return Splitters(keys, owners)

    def around(self, part: int) -> list[tuple[bytes, list[int]]]:
        """The splitters on either side of a part, with their owners."""
        return [(self.keys[j][0], self.owners[j]) for j in (part - 1, part) if 0 <= j < len(self.keys)]


def choose_splitters(paths: DataFrame, part_bytes: int) -> Splitters:
    size = paths.agg(F.sum(F.length("path") + F.lit(2 * TURN)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, round((size["b"] or 0) / part_bytes))
    wanted = min(SAMPLE * parts, SAMPLES)
    if parts == 1:
        return Splitters([], [])
    share = max(1, size["n"] // wanted)
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(share)) == 0).select("path", "conv_id").toLocalIterator())
    return Splitters.of(sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else [])


def sorted_runs(split: Splitters, run_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows of conv_id, path and words as sorted runs, in rows of ``RUN``."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, list[int]]] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append((row["path"], row["conv_id"], row["words"]))
                size += len(row["path"]) + 2 * TURN
                if size >= run_bytes:
                    yield as_run(held)
                    held, size = [], 0
        if held:
            yield as_run(held)

    def as_run(held: list[tuple[bytes, int, list[int]]]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[:2])
        # a run is named by what it holds: a task that is run again gives the same name
        name = hashlib.sha256(b"".join(p + i.to_bytes(8, "big", signed=True) for p, i, _ in held)).hexdigest()[:32]
        out, last, last_part = [], b"", -1
        for seq, (path, conv_id, words) in enumerate(held):
            part = bisect_right(split.keys, (path, conv_id))
            lcp = common_turns(last, path) if part == last_part else 0
            out.append((part, name, seq, lcp, path[lcp * TURN :], words[lcp:], conv_id))
            last, last_part = path, part
        names = [c.split()[0] for c in RUN.split(", ")]
        types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return runs


# ---- merging

@dataclass
class Player:
    """The first conversation left of a run; ``lcp`` is its LCP with the last one that the tree gave."""

    path: bytes
    words: list[int]
    conv_id: int
    lcp: int
    rest: Iterator[tuple[int, bytes, list[int], int]]

    def advance(self) -> bool:
        for lcp, rest, words, conv_id in self.rest:
            self.path, self.words, self.conv_id, self.lcp = self.path[: lcp * TURN] + rest, self.words[:lcp] + words, conv_id, lcp
            return True
        return False


class LoserTree:
    """Merges runs. Players that lost wait in the inner nodes, with their LCP with whom they lost to."""

    def __init__(self, runs: Iterable[Iterable[tuple[int, bytes, list[int], int]]]):
        self.compared = 0  # turns
        players = [Player(b"", [], 0, 0, iter(r)) for r in runs]
        self.leaves = 1 << max(0, len(players) - 1).bit_length()
        self.waiting: list[Player | None] = [None] * self.leaves
        self.place = {}
        level: list[Player | None] = [p if p.advance() else None for p in players]
        level += [None] * (self.leaves - len(level))
        self.place = {id(p): self.leaves + k for k, p in enumerate(level) if p}
        node = self.leaves
        while len(level) > 1:
            node //= 2
            met = [self.play(a, b) for a, b in zip(level[::2], level[1::2], strict=True)]
            self.waiting[node : node + len(met)] = [loser for _, loser in met]
            level = [winner for winner, _ in met]
        self.winner = level[0] if level else None

    def play(self, a: Player | None, b: Player | None) -> tuple[Player | None, Player | None]:
        """Winner and loser. Who shares more with the last winner is the smaller; of equal ones, turns beyond tell."""
        if a is None or b is None:
            return (a or b), None
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        same = common_turns(a.path, b.path, a.lcp)
        self.compared += same - a.lcp + 1
        at = slice(same * TURN, (same + 1) * TURN)
        winner, loser = (a, b) if (a.path[at], a.conv_id) <= (b.path[at], b.conv_id) else (b, a)
        loser.lcp = same
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, bytes, list[int], int]]:
        """LCP with the one before, path, words and conv_id, in order."""
        while (top := self.winner) is not None:
            yield top.lcp, top.path, top.words, top.conv_id
            node = self.place[id(top)] // 2
            best = top if top.advance() else None
            while node:
                best, self.waiting[node] = self.play(best, self.waiting[node])
                node //= 2
            self.winner = best


@dataclass
class Open:
    """A node on the path of the conversation read last. ``owner`` is set where it is a prefix of a splitter, or the root."""

    depth: int
    words: int
    owner: int | None
    conv_id: int
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    digest: Any = field(default_factory=hashlib.sha256)
    ends: list[int] = field(default_factory=list)
    n_ends: int = 0
    done: list[tuple] = field(default_factory=list)  # children, which wait for this node's least member


def finished_nodes(merged: Iterable[tuple[int, bytes, list[int], int]], split: Splitters, part: int) -> Iterator[tuple]:
    """Rows of ``NODE`` from a part's conversations in order: nodes (their parent known), those whose parent is shared
    with other parts (its owner and depth - 1 name it), partial sums of shared nodes, and pieces of lists of ids."""
    around = split.around(part)

    def owner_of(path: bytes, depth: int) -> int | None:
        if not depth:
            return 0
        return next((owners[depth] for of, owners in around if len(of) >= depth * TURN and of[: depth * TURN] == path[: depth * TURN]), None)

    stack = [Open(0, 0, 0, 2**63 - 1)]

    def close() -> Iterator[tuple]:
        x, up = stack.pop(), stack[-1] if stack else None
        if x.owner is not None:
            if x.ends:
                yield ids_of(x)
            yield ("partial", x.conv_id, x.depth, None, x.n_convs, x.n_children, x.n_leaves, x.saved, None, x.owner, x.words, part, None, None)
            yield from (("child", *c[:2], None, *c[2:], x.owner, None, part, None, None) for c in x.done)
        else:
            x.n_leaves, x.saved = x.n_leaves or 1, x.saved + (x.n_convs - 1) * x.words
            yield from (("node", *c[:2], x.conv_id, *c[2:], None, None, part, None, None) for c in x.done)
            assert up is not None
            up.n_children, up.n_leaves, up.saved = up.n_children + 1, up.n_leaves + x.n_leaves, up.saved + x.saved
            up.done.append((x.conv_id, x.depth, x.n_convs, x.n_children, x.n_leaves, x.saved, x.digest.hexdigest()))
        if up is not None:
            up.n_convs, up.conv_id = up.n_convs + x.n_convs, min(up.conv_id, x.conv_id)

    def ids_of(x: Open) -> tuple:
        x.n_ends, ids, x.ends = x.n_ends + 1, x.ends, []
        return ("ends", None, x.depth, None, None, None, None, None, None, x.owner, None, part, x.n_ends, ",".join(map(str, ids)))

    for lcp, path, words, conv_id in merged:
        while len(stack) > lcp + 1:
            yield from close()
        for depth in range(lcp + 1, len(words) + 1):
            stack.append(Open(depth, words[depth - 1], owner_of(path, depth), conv_id))
        top = stack[-1]
        top.n_convs, top.conv_id = top.n_convs + 1, min(top.conv_id, conv_id)
        if top.owner is None:
            top.digest.update(f"{',' if top.n_ends else ''}{conv_id}".encode())
            top.n_ends += 1
        else:
            top.ends.append(conv_id)
            if len(top.ends) >= ENDS:
                yield ids_of(top)
    while stack:
        yield from close()


def merge_part(split: Splitters) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas: a part's rows of ``RUN`` as rows of ``NODE``."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["run", "seq"], kind="stable")
        runs = [zip(g["lcp"].tolist(), g["rest"].tolist(), (w.tolist() for w in g["words"]), g["conv_id"].tolist(), strict=True) for _, g in rows.groupby("run", sort=False)]
        found = list(finished_nodes(LoserTree(runs), split, int(rows["part"].iloc[0])))
        names = [c.split()[0] for c in NODE.split(", ")]
        return pd.DataFrame({n: pd.Series(c, dtype="object") for n, c in zip(names, zip(*found, strict=True), strict=True)})

    return merge


# ---- what parts share

def close_shared(partials: list[dict], split: Splitters) -> list[tuple]:
    """owner, depth, and a row of results without digest for each shared node, from its added sums. Deepest first, each
    node adds to the prefix one turn shorter."""
    nodes = {(p["owner"], p["depth"]): dict(p) for p in partials}
    done, shared_children = [], dict.fromkeys(nodes, 0)
    for owner, depth in sorted(nodes, key=lambda k: -k[1]):
        x = nodes[owner, depth]
        x["n_leaves"], x["saved"] = x["n_leaves"] or 1, x["saved"] + (x["n_convs"] - 1) * x["words"]
        x["n_children"] += shared_children[owner, depth]
        parent = (split.owners[owner][depth - 1], depth - 1) if depth else None
        if parent:
            up = nodes[parent]
            shared_children[parent] += 1
            up["n_leaves"], up["saved"] = up["n_leaves"] + x["n_leaves"], up["saved"] + x["saved"]
        done.append((owner, depth, x["conv_id"], nodes[parent]["conv_id"] if parent else None, x["n_convs"], x["n_children"], x["n_leaves"], x["saved"]))
    return done


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows in order of owner, depth, part and piece; a digest for each owner and depth."""
    key, digest, out = None, hashlib.sha256(), []
    for batch in batches:
        for r in batch.to_pylist():
            if key != (r["owner"], r["depth"]):
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (r["owner"], r["depth"]), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(r["ends"].encode())
    if key is not None:
        out.append((*key, digest.hexdigest()))
        columns = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["owner", "depth", "ends_sha256"])


def trie_of(paths: DataFrame, part_bytes: int = PART_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The nodes of rows with conv_id (each once), path and words."""
    spark: SparkSession = paths.sparkSession
    split = choose_splitters(paths, part_bytes)
    runs = paths.select("conv_id", "path", "words").mapInArrow(sorted_runs(split, run_bytes), RUN)
    found = materialise(runs.groupBy("part").applyInPandas(merge_part(split), NODE), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")] + [F.sum("saved_tokens").alias("saved"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words")]
    partials = found.where("kind = 'partial'").groupBy("owner", "depth").agg(*sums)
    closed = close_shared([r.asDict() for r in partials.toLocalIterator()], split)  # at most the splitters' turns
    shared = spark.createDataFrame(closed, "owner int, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = found.where("kind = 'ends'").select("owner", "depth", "part", "piece", "ends")
    hashed = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part", "piece").mapInArrow(hash_ends, "owner int, depth int, ends_sha256 string")
    tops = shared.join(hashed, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    above = shared.select("owner", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # as many rows as shared nodes, which the sample of splitters bounds
    children = found.where("kind = 'child'").drop("parent_conv_id").join(F.broadcast(above), ["owner", "depth"])
    names = [c.split()[0] for c in OUT.split(", ")]
    parts = [x.select(*names) for x in (found.where("kind = 'node'"), children, tops)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("depth", F.col("depth").cast("long"))


def prefix_trie(df: DataFrame, **sizes: int) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    * Null roles and texts count as empty. Rows without conv_id belong to no conversation and are left out.
    * Turns of null number come first; turns of one number (ties) are in order of their digests, repeated rows stay turns.
    * Very long texts are hashed and counted where they lie and never sent. A conversation is one record of 20 bytes a turn.
    * An empty table has no conversation, so no node, not even a root.
    * Only conv_id, turn, role and text are read, whatever the other columns are called.
    """
    spark, paths = df.sparkSession, rebuilt(df)
    table = write_table(paths, "trie-paths")
    found = trie_of(spark.read.schema(paths.schema).parquet(table), **sizes)
    drop_table(spark, table)  # read for the last time where the nodes were written
    return found


def oracle_sql() -> str:
    """By lists of turns as keys; each leaf and each node adds to all its prefixes."""
    return r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'k': sha256(concat(strlen(role), ':', role, text)), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}
                            ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS turns FROM t GROUP BY conv_id),
        h AS (SELECT o.conv_id, o.turns, b.turns AS head, CRC AS h
              FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
        r AS (SELECT conv_id, list_concat(coalesce(head[1:h], []), turns[h + 1:]) AS turns FROM h),
        p AS (SELECT conv_id, len(turns) AS n, CAST(d AS BIGINT) AS depth, list_transform(turns[1:d], lambda x: x.k) AS key, CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w
              FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
        node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
                        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
                 FROM p GROUP BY key, depth),
        kids AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
        up AS (SELECT key[1:d] AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
               FROM (SELECT n.key, CASE WHEN k.key IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved, unnest(range(depth + 1)) AS d
                     FROM node n LEFT JOIN kids k ON n.key = k.key) GROUP BY 1)
        SELECT n.conv_id, n.depth, f.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
               CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM node n JOIN up u ON n.key = u.key LEFT JOIN kids k ON n.key = k.key LEFT JOIN node f ON n.depth > 0 AND f.key = n.key[1:n.depth - 1]""".replace("CRC", CRC32_SQL)


#: The reflected polynomial of crc32 (fixed), eight steps a byte, in a list function.
CRC32_SQL = (
    "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(o.conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) "
)
CRC32_SQL = f"CAST(xor({CRC32_SQL}, 4294967295::UBIGINT) % 4 AS BIGINT)"
