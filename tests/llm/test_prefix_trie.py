"""The prefix trie against plain prefixes of whole sequences, in one part and in many."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from docflow.llm.prefix_trie import LoserTree, Splitters, common_turns, oracle_sql, prefix_trie, rebuilt, trie_of

SCHEMA = "conv_id long, turn long, role string, text string, path string, words long, `depth` string"


def conversations(seed, n=150):
    r = random.Random(seed)
    said = [(r.choice(["user", "assistant", None]), r.choice([None, "", " \n", "a b", "ünï 漢字 x", "word " * 30, "yes", "no"])) for _ in range(14)]
    rows = []
    for c in r.sample(range(-60, 400), n):
        kind, length = r.random(), r.choice([1, 1, 2, 3, 5, 8, 40])
        turns = [said[k % 14] for k in range(length)] if kind < 0.5 else [r.choice(said) for _ in range(length)]
        numbers = [None if k == 0 and r.random() < 0.2 else k for k in range(length)]
        rows += [(c, t, *x) for t, x in zip(numbers, turns, strict=True)]
    rows += [rows[5], rows[5], (None, 1, "user", "no conversation"), (1000, 3, "user", "long " * 20_000), (1001, 0, "user", "tie"), (1001, 0, "user", "tie two"), (1001, 0, "system", "tie")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "p", 1, "d") for x in rows], SCHEMA).repartition(6)


def sequences(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    trunc = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: tuple(own.get(trunc(c), [])[: h[c]] + v[h[c] :]) for c, v in own.items()}


def brute(rows):
    members, ends = {}, {}
    for c, s in sequences(rows).items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(m) - 1) * words
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], digest(s)) for s, m in members.items()), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 1500, "run_bytes": 600}])
def test_agrees_with_plain_prefixes(spark, seed, sizes):
    rows = conversations(seed)
    assert rows_of(prefix_trie(frame(spark, rows), **sizes)) == brute(rows)


def test_copies_are_split_over_parts(spark, monkeypatch):
    monkeypatch.setattr("docflow.llm.prefix_trie.ENDS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(6) if c % 20]
    paths = rebuilt(frame(spark, rows)).cache()
    assert rows_of(trie_of(paths, part_bytes=3000, run_bytes=2000)) == brute(rows) == rows_of(trie_of(paths))


def test_agrees_with_sql(spark):
    rows = conversations(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.sql(oracle_sql())
    assert sorted(map(tuple, found.fetchall()), key=repr) == brute(rows)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_few_conversations(spark):
    assert rows_of(prefix_trie(frame(spark, []))) == rows_of(prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []
    for rows in ([(7, 0, "a", "b")], [(7, None, None, None), (7, None, None, None)]):
        assert rows_of(prefix_trie(frame(spark, rows))) == brute(rows)


def test_tree_gives_order_and_common_turns_and_compares_few():
    r = random.Random(5)
    turn = [bytes([k]) * 16 for k in range(3)]
    stem = b"".join(turn[k % 3] for k in range(200))
    all_rows, runs = [], []
    for _ in range(11):
        run = sorted((stem + b"".join(r.choice(turn) for _ in range(r.randint(0, 6))), r.randrange(10**6)) for _ in range(r.randint(0, 60)))
        all_rows += run
        coded, last = [], b""
        for path, conv_id in run:
            lcp = common_turns(last, path)
            coded.append((lcp, path[16 * lcp :], [1] * (len(path) // 16 - lcp), conv_id))
            last = path
        runs.append(coded)
    tree = LoserTree(runs)
    found = list(tree)
    assert [(p, c) for _, p, _, c in found] == sorted(all_rows)
    paths = [b"", *(p for _, p, _, _ in found)]
    assert [lcp for lcp, *_ in found] == [common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)]
    assert all(len(w) == len(p) // 16 for _, p, w, _ in found)
    assert tree.compared < 11 * 207 + 8 * len(all_rows)  # the stem of 200 turns is compared once a run, not once a row


def test_owners_are_first_splitters():
    a, b, c = (bytes([k]) * 16 for k in range(3))
    split = Splitters.of([(a + b, 1), (a + b, 5), (a + b + c, 0), (a + c, 2), (b, 1)])
    assert split.owners == [[0, 0, 0], [0, 0, 0], [0, 0, 0, 2], [0, 0, 3], [0, 4]]
