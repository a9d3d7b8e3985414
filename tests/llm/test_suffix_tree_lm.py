import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.llm import suffix_tree_lm as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def test_base_columns(docs, rows):
    count = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = sorted(((d, out(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows), key=repr)
    found = lm.score_documents(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == expected
    assert all(r.score <= 0 for r in found)


def plain_tree(train, depth, least_state, least_pair, divergence, discount):
    """The tree by the book, from lists of words: context to (rest, kept followers)."""
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    common = {w for w, c in count.items() if c >= max(1, least_pair * n)}
    root = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    retained, heavy = {}, set()

    def p(context, w):
        value = root(w)
        for k in range(1, len(context) + 1):
            s = context[len(context) - k :]
            if s in retained:
                rest, mass = retained[s]
                value = rest * value + mass.get(w, 0.0)
        return value

    def p_class(context):
        """Of any word that isn't common."""
        return p(context, None) / root(None) * (1 - sum(root(w) for w in common))

    candidates = {(w,) for w in common if w != "</s>" and count[w] >= max(2, least_state * n)}
    for d in range(1, depth + 1):
        heavy |= candidates
        total, pairs = Counter(), Counter()
        for t in train:
            for i in range(d, len(t)):
                s = tuple(t[i - d : i])
                if s in candidates:
                    total[s] += 1
                    if t[i] in common:
                        pairs[s, t[i]] += 1
        kept = {k: c for k, c in pairs.items() if c >= max(2, least_pair * n)}
        new = {}
        for s in candidates:
            mass = {w: (c - discount) / total[s] for (x, w), c in kept.items() if x == s}
            rest = 1 - sum(mass.values())
            parent = {w: p(s[1:], w) for w in mass}
            q = {w: mass[w] + rest * parent[w] for w in mass}
            other, parent_other = max(1 - sum(q.values()), 1e-12), max(1 - sum(parent.values()), 1e-12)
            gain = sum(q[w] * math.log(q[w] / parent[w]) for w in mass) + other * math.log(other / parent_other)
            if total[s] and gain >= divergence:
                new[s] = (rest, mass)
        retained |= new
        candidates = {(*s, w) for (s, w), c in kept.items() if c >= max(2, least_state * n) and (*s, w)[1:] in candidates}
    symbol = lambda w: w if w in common else None
    followers, states = {}, {}
    for t in train:
        for i in range(depth, len(t) if depth else 0):
            s = tuple(t[i - depth : i])
            if s not in heavy:
                followers.setdefault(s, Counter())[symbol(t[i])] += 1
    for s, count_of in followers.items():
        mass = {w: (c - discount) / count_of.total() for w, c in count_of.items() if c >= 2}
        rest = 1 - sum(mass.values())
        parent = {w: p_class(s) if w is None else p(s, w) for w in mass}
        q = {w: mass[w] + rest * parent[w] for w in mass}
        other, parent_other = max(1 - sum(q.values()), 1e-12), max(1 - sum(parent.values()), 1e-12)
        if mass and sum(q[w] * math.log(q[w] / parent[w]) for w in mass) + other * math.log(other / parent_other) >= divergence:
            states[s] = (rest, mass)

    def whole(context, w):
        if context not in states:
            return p(context, w)
        rest, mass = states[context]
        low = p(context, w) if w in common else p_class(context)
        return p(context, w) * (mass.get(symbol(w), 0.0) / low + rest)

    return whole, retained, states, root


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_scores_are_those_of_a_plain_tree(docs, rows, depth):
    options = {"depth": depth, "least_state": 0.002, "least_pair": 0.0005, "divergence": 0.05, "discount": 0.5}
    train = [tokens(t) for d, t in rows if not out(d)]
    p, retained, light, _ = plain_tree(train, **options)
    if depth:
        assert retained and light
    expected = sorted(((d, sum(math.log10(p(tuple(w[max(0, i - depth) : i]), x)) for i, x in enumerate(w))) for d, t in rows for w in [tokens(t)]), key=repr)
    found = lm.score_documents(docs, **options).collect()
    found = sorted(((r.doc_id, r.score) for r in found), key=repr)
    by_score = lambda x: (x[0] is None, x[0] or 0, round(x[1], 1), x[1])
    for (d, x), (e, y) in zip(sorted(found, key=by_score), sorted(expected, key=by_score), strict=True):
        assert d == e and x == pytest.approx(y, rel=1e-5, abs=1e-4)


def plain_states_of_every_length(train, depth, least_state, least_pair, divergence, discount):
    """Score of a word after a context: the heavy part by plain_tree, then light states of each length by the book."""
    _, retained, _, root = plain_tree(train, depth, least_state, least_pair, divergence, discount)
    count = Counter(w for t in train for w in t)
    n = sum(count.values())
    common = {w for w, c in count.items() if c >= max(1, least_pair * n)}
    least = max(2, least_state * n, least_pair * n)
    runs = [Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(depth + 2)]
    heavy = {(w,) for w in common if w != "</s>" and count[w] >= max(2, least_state * n)}
    for k in range(2, depth + 1):
        heavy |= {s for s, c in runs[k].items() if c >= least and s[:-1] in heavy and s[1:] in heavy and s[-1] in common}
    symbol = lambda w: w if w in common else None
    states = {}

    def p(context, w):
        value = root(w) if w in common else 1 - sum(map(root, common))
        for k in range(1, len(context) + 1):
            s = context[len(context) - k :]
            rest, mass = (retained if s in heavy else states).get(s, (1, {}))
            value = rest * value + mass.get(symbol(w), 0.0)
        return value

    for k in range(1, depth + 1):
        followers = {}
        for s, c in runs[k + 1].items():
            if s[:-1] not in heavy and "</s>" not in s[:-1]:
                followers.setdefault(s[:-1], Counter())[symbol(s[-1])] += c
        new = {}
        for s, of in followers.items():
            mass = {w: (c - discount) / of.total() for w, c in of.items() if c >= 2}
            rest, parent = 1 - sum(mass.values()), {w: p(s[1:], w) for w in mass}
            q = {w: mass[w] + rest * parent[w] for w in mass}
            other, parent_other = max(1 - sum(q.values()), 1e-12), max(1 - sum(parent.values()), 1e-12)
            if mass and sum(q[w] * math.log(q[w] / parent[w]) for w in mass) + other * math.log(other / parent_other) >= divergence:
                new[s] = (rest, mass)
        states |= new
    outside = 1 - sum(map(root, common))
    return (lambda context, w: p(context, w) * (1 if w in common else root(w) / outside)), states


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_light_contexts_of_every_length_have_states(docs, rows, depth):
    options = {"depth": depth, "least_state": 0.002, "least_pair": 0.0005, "divergence": 0.05, "discount": 0.5}
    train = [tokens(t) for d, t in rows if not out(d)]
    p, states = plain_states_of_every_length(train, **options)
    assert {len(s) for s in states} == set(range(1, depth + 1))
    expected = sorted(((d, sum(math.log10(p(tuple(w[max(0, i - depth) : i]), x)) for i, x in enumerate(w))) for d, t in rows for w in [tokens(t)]), key=repr)
    found = [(r.doc_id, r.score) for r in lm.score_documents(docs, every_length=True, **options).collect()]
    by_score = lambda x: (x[0] is None, x[0] or 0, round(x[1], 1), x[1])
    for (d, x), (e, y) in zip(sorted(found, key=by_score), sorted(expected, key=by_score), strict=True):
        assert d == e and x == pytest.approx(y, rel=1e-5, abs=1e-4)


def test_tokens_take_few_bytes_on_the_way():
    """A common word's number compresses where its bytes stand by themselves."""
    r = np.random.default_rng(0)
    numbers = np.minimum(r.zipf(1.3, 5_000), 200_000).astype("<u4")
    data = lm.folded(lm.low_bytes(numbers, 3), r.integers(0, 2**64, 5_000, dtype=np.uint64))
    assert len(data) < 5_000 * 9.2
    assert (lm.unfolded(data, "u3", "u8")[0] == numbers).all()


def test_probabilities_sum_to_one_at_most(rows):
    train = [tokens(t) for d, t in rows if not out(d)]
    p, retained, light, _ = plain_tree(train, 2, 0.002, 0.0005, 0.05, 0.5)
    words = {w for t in train for w in t}
    for s in list(retained)[:20] + list(light)[:20]:
        assert sum(p(s, w) for w in words) <= 1 + 1e-9


def test_no_training_rows(docs):
    found = lm.score_documents(docs.limit(10), held_out=F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score - r.base_score) < 1e-9 for r in found)


def test_no_rows(no_docs):
    assert lm.score_documents(no_docs).count() == 0


def test_counter_sums_across_parts(monkeypatch):
    monkeypatch.setattr(lm, "GATHERED", 10)
    c = lm.Counter()
    r = np.random.default_rng(0)
    parts = [r.integers(0, 30, 25).astype(np.uint64) for _ in range(9)]
    for x in parts:
        c.add(x)
    keys, counts = c.result()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def test_tokens_end_each_text():
    t, text = lm.tokens_of(pa.array(["a b", "", None, "A"]))
    assert text.tolist() == [0, 0, 0, 1, 2, 3, 3] and (t[[2, 3, 4, 6]] == lm.END).all() and t[0] == t[5]


def test_folded_columns_come_back():
    r = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys, refs, p = r.integers(0, 2**48, n).astype("<u8"), r.integers(0, 2**32, n).astype("<u4"), r.random(n)
        data = lm.folded(keys.view(np.uint8).reshape(-1, 8)[:, :6], refs, p) if n else lm.folded(np.empty((0, 6), np.uint8), refs, p)
        for x, y in zip(lm.unfolded(data, "u6", "u4", "f8"), (keys, refs, p), strict=True):
            assert x.tolist() == y.tolist()
