import math
import random
import re

import pytest

from docflow.llm import license_scan as ls


def words(t):
    return re.findall(r"[^\W_]+(?:\.[^\W_]+)*", (t or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows, templates, threshold=0.75):
    out = set()
    for d, t in set(rows):
        w = words(t)
        for name, text in templates.items():
            own, n = set(shingles(words(text))), len(words(text))
            span, step = ls.window_words(n), ls.stride(n)
            hits = [(len(own & set(shingles(w[s : s + span]))) / len(own), -s, len(w[s : s + span])) for s in range(0, max(len(w) - span + step, 1), step) if w[s:]]
            hits = [h for h in hits if h[0] >= threshold]
            if hits:
                best = max(hits)
                out.add((d, name, best[0], -best[1], best[2], len(hits)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def scanned(rows):
    r = random.Random(9)
    fixed = list(ls.TEMPLATES.values())
    out = []
    for i, (d, t) in enumerate(rows):
        line = r.choice(fixed)
        if i % 7 == 0:
            w = line.split(" ")
            w[r.randrange(len(w))] = "other"
            line = " ".join(w)
        out.append((d, t if i % 3 or t is None else f"{t[: len(t) // 2]}\n{line.upper() if i % 2 else line}\n{t[len(t) // 2 :]}"))
    return [*out, (77, ls.TEMPLATES["gpl-3.0"] * 3), (78, "License"), (79, "all rights"), (77, ls.TEMPLATES["gpl-3.0"] * 3)]


def test_matches_are_those_of_all_windows(spark, scanned):
    df = spark.createDataFrame(scanned, "doc_id long, text string")
    found = sorted((tuple(r) for r in ls.scan(df).collect()), key=repr)
    assert found == brute(scanned, ls.TEMPLATES)
    assert len({f[1] for f in found}) == len(ls.TEMPLATES)


def test_bands_guarantee_collisions():
    for n in range(1, 60):
        s = ls.least_similarity(n, 0.75)
        assert (1 - s) ** ls.bands(n, 0.75, 1e-6) <= 1e-6 or s == 1
        assert ls.stride(n) >= 1 and ls.window_words(n) - ls.stride(n) == n - 1
    assert math.isclose(ls.least_similarity(7, 0.75), 0.75)


def test_marks_are_in_every_shingle():
    chosen = set(ls.marks(ls.TEMPLATES))
    for t in ls.TEMPLATES.values():
        assert all(chosen & set(s) for s in shingles(words(t)))


def test_no_rows(no_docs):
    assert ls.scan(no_docs).count() == 0 and ls.scan(no_docs, {}).count() == 0
