import re

import numpy as np
import pytest

from docflow.llm import jaccard_join as jj
from docflow.llm.jaccard_join import Threshold, alike, at_least_apart, drop_near_copies, far_apart, range_counts, similar_groups


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            same = bool(x) and x == y
            near = x and y and 100 * len(x & y) >= 75 * len(x | y)
            if same or near:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), 2**63), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_components_are_those_of_all_pairs(docs, rows):
    found = sorted((tuple(r) for r in similar_groups(docs).collect()), key=repr)
    expected = brute(rows)
    assert found == expected
    assert len({c for _, _, c in expected}) < len(rows) - 20


def test_one_row_of_each_group_stays(docs, rows):
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    stays = {d for d, n, c in brute(rows) if d is None or c is None or c >= d}
    expected = [d for d, _ in rows if d is None or d in stays]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, expected))


def test_a_group_of_near_copies_around_no_hub(spark):
    """A chain: neighbours are alike, ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in similar_groups(df).collect()} == {0}


def test_shingles_with_several_buckets_and_ids_met_by_a_shuffle(docs, rows, monkeypatch):
    from docflow.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FEW_IDS", 0)
    monkeypatch.setattr(jaccard_join, "PARTS_AT_ONCE", 2)
    assert sorted((tuple(r) for r in similar_groups(docs, salt_count=2).collect()), key=repr) == brute(rows)


def test_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join(words[:-1])), (None, " ".join(words[:-2])), (-5, " ".join(words[1:])), (3, "apart " * 9), (None, "nul l"), (2**63 - 1, "nul l")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in similar_groups(df).collect()), key=repr) == brute(rows)
    alone = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert {r.component_id for r in similar_groups(alone).collect()} == {None}


def test_columns_that_clash_keep_their_values(spark):
    same = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, same, "g1", "n1", 7), (2, same, "g2", "n2", 8), (3, "else", "g3", None, 9)], "doc_id long, text string, gone string, _gone string, component_id long")
    assert sorted(map(tuple, drop_near_copies(df).collect())) == [(1, same, "g1", "n1", 7), (3, "else", "g3", None, 9)]


def test_no_rows(no_docs):
    assert similar_groups(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_suffix_filter_is_a_lower_bound(seed):
    r = np.random.default_rng(seed)
    x, y = (np.unique(r.integers(0, 80, r.integers(1, 60))).astype(np.uint64) for _ in range(2))
    apart = len(set(x.tolist()) ^ set(y.tolist()))
    assert far_apart(x, y, 10**9) <= apart
    both, either = len(set(x.tolist()) & set(y.tolist())), len(set(x.tolist()) | set(y.tolist()))
    assert alike(x, y, Threshold()) == (100 * both >= 75 * either)


def test_range_counts_never_say_too_much():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.choice([1, 2, 5, 17, 40, 300, 3000]))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.choice([0.1, 0.8, 1.0])], r.integers(0, 2**63, int(r.integers(0, n * 2 + 1))).astype(np.uint64)]))
        if len(y):
            apart = len(np.setxor1d(x, y))
            assert at_least_apart(range_counts(x), range_counts(y)) <= apart
            assert at_least_apart(range_counts(x), range_counts(x)) == 0
    x, y = (np.unique(r.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2))
    assert at_least_apart(range_counts(x), range_counts(y)) > 84  # strangers are told apart
    crowd = np.arange(4000, dtype=np.uint64)
    assert at_least_apart(range_counts(crowd), range_counts(crowd[:900])) <= 3100


def test_entries_take_few_bytes_and_come_back(docs):
    rows = docs.selectExpr("doc_id", "text").coalesce(1)
    found = jj.entries(rows, np.zeros(1 << jj.SKETCH_BITS, dtype="<u4"), 4, Threshold(), 10).collect()
    entries = [jj.unpacked(r["packed"]) for r in found]
    assert sum(len(r["packed"]) for r in found) <= 26 * sum(map(len, entries))
    known = {}  # by set: size, shingles
    for r in rows.toArrow().to_batches():
        for _, shingles, at in jj.document_sets(r):
            known |= {jj.fingerprint(x): {int(y) & (1 << 48) - 1 for y in x} for x in np.split(shingles, at[1:-1]) if len(x)}
    assert known
    for e in entries:
        for x, name in zip(e, jj.binary(e["lo"], e["hi"]).to_pylist(), strict=True):
            assert int(x["shingle"]) in known[name] and int(x["size"]) == len(known[name])
