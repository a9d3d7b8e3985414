"""Windows are made around whole shingles only, and all of those are."""

import random

from pyspark.sql import functions as F

from docflow.llm import license_scan as scan


def test_windows_are_those_that_hold_a_shingle(spark):
    r = random.Random(4)
    known = scan.class_shingles(scan.TEMPLATES)
    notices = list(map(scan.template_words, scan.TEMPLATES.values()))
    texts = []
    for _ in range(60):
        words = []
        while len(words) < r.choice([0, 2, 6, 40, 150]):
            notice = r.choice(notices)
            words += notice[r.randrange(len(notice)) :] if r.random() < 0.3 else notice if r.random() < 0.3 else r.choices(["a", "licensed", "the", "all", "rights"], k=r.randint(1, 30))
        texts.append(words)
    df = spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "k int, words array<string>")
    for n, x in known.items():
        m, span, step = min(n, scan.SHINGLE), scan.window_words(n), scan.stride(n)
        found = df.select("k", F.array_sort(scan.first_words(scan.hits(F.col("words"), m, x), F.col("words"), n, x)).alias("f")).collect()
        made = sum(len(row.f) for row in found)
        everything = 0
        for row in found:
            words = texts[row.k]
            begins = [f for f in range(0, max(len(words) - span + step - 1, 0) + 1, step) if f < len(words)]
            everything += len(begins)
            assert row.f == [f for f in begins if any(" ".join(words[p : p + m]) in x for p in range(f, min(f + span, len(words)) - m + 1))]
        assert made < everything
