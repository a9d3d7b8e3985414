import hashlib
import random

import numpy as np
import pytest

from docflow.llm.suffix_dedup import least_owner, remove_repeats, sliding_min, window_hashes


def brute(rows, n=50):
    out, top = [], 2**63 - 1
    first = {}
    for d, t in rows:
        b, d = (t or "").encode(), top if d is None else d
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(first.get(w, top + 1), d)
    for d, t in rows:
        b, own = (t or "").encode(), top if d is None else d
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < own:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_bytes_removed_are_those_of_all_windows(docs, rows):
    found = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=repr)
    assert found == brute(rows)
    assert sum(r[2] > 0 for r in found) > 30


@pytest.mark.parametrize("length", [21, 51])
def test_shortest_and_longest_strings(docs, rows, length):
    assert sorted((tuple(r) for r in remove_repeats(docs, length=length).collect()), key=repr) == brute(rows, length)


def test_lengths_that_have_no_mask(docs):
    for length in (20, 52):
        with pytest.raises(ValueError):
            remove_repeats(docs, length=length)


def test_texts_with_many_rows(spark, rows, monkeypatch):
    from docflow.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    many = [*rows, *((20_000 + i, rows[40 + i % 3][1]) for i in range(60)), *((None, rows[50][1]) for _ in range(5)), *((i, "passed on " * 9) for i in (7, 7, 7, 3))]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=repr) == brute(many)


def test_no_rows(no_docs):
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_merged_transforms_find_the_least_owner(seed, monkeypatch):
    from docflow.llm import suffix_dedup

    r = random.Random(seed)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", r.choice([50, 200, 10_000]))
    size, n = r.choice([3, 8, 20]), r.choice([1, 2, 3, 17, 40])
    contexts = ["".join(r.choice("ab" if r.random() < 0.9 else "abc") for _ in range(r.randint(1, 60))).encode() for _ in range(n)]
    owner = np.array([r.randrange(10) for _ in contexts], dtype=np.int64)
    found = least_owner(contexts, owner, size)
    best = {}
    for c, o in zip(contexts, owner.tolist(), strict=True):
        for i in range(len(c) - size + 1):
            best[c[i : i + size]] = min(best.get(c[i : i + size], 99), o)
    assert [x.tolist() for x in found] == [[best[c[i : i + size]] for i in range(max(0, len(c) - size + 1))] for c in contexts]


def test_all_byte_values():
    contexts = [bytes(range(256)), bytes(range(100, 256)) + bytes(range(50))]
    found = least_owner(contexts, np.array([5, 3]), 50)
    assert found[0].tolist() == [3] + [5] * 99 + [3] * 107 and found[1].tolist() == [3] * 157


def test_rolling_parts():
    r = np.random.default_rng(0)
    data = r.integers(0, 3, 400).astype(np.uint8)
    h = window_hashes(data, 20)
    assert len(h) == 381
    same = {}
    for i in range(381):
        assert same.setdefault(data[i : i + 20].tobytes(), h[i]) == h[i]
    assert len(set(h.tolist())) == len(same)
    for w in (1, 2, 5, 31):
        assert sliding_min(h, w).tolist() == [min(h[i : i + w].tolist()) for i in range(381 - w + 1)]


def test_an_anchor_with_many_contexts_falls_apart(spark, monkeypatch):
    """Texts with one phrase in common: its contexts have cores of their own, so none is left for the transforms."""
    from docflow.llm import suffix_dedup

    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    wide, sizes, h = np.zeros((500, 80), np.uint8), np.full(500, 80, np.uint8), np.empty(500, np.uint64)
    for i in range(500):
        wide[i] = np.frombuffer((text(30) + "one phrase in common" + text(30)).encode(), np.uint8)
        h[i] = window_hashes(wide[i], 20)[30] >> np.uint64(16)
    member, shift, core, part, size = suffix_dedup.halves(wide, sizes, h, 50)
    assert np.bincount(member).tolist() == [2] * 500 and sorted(set(shift.tolist())) == [0, 15] and sorted(set(size.tolist())) == [64, 65]
    sub, heads, _ = suffix_dedup.collapsed(core, part, size, member)
    assert len(set(core.tolist())) == len(heads) == len(set(sub.tolist())) == 1000
    texts = [text(r.choice([10, 40])) + "one phrase in common" + r.choice(["", " of these texts, and", " of these texts, and what follows it as well"]) + text(40) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, t[5:70] + t[3:]) for i, t in enumerate(texts[:50])]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(x) for x in found.collect()), key=repr) == brute(rows)
