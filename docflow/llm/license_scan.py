"""License scans with DataFrame functions only.

Templates are licence notices. Texts are read as lower-case words; the words of a text are cut into overlapping windows
a little longer than the templates of a class (those with equally many words). Each window gets MinHash values of its
five-word shingles, one row for each band; the bands of the templates retrieve candidates by an equi-join, and the
exact share of the template's shingles that the window contains decides.

A window that holds ``threshold`` of a template has at least the Jaccard similarity of ``least_similarity``; the
number of bands is chosen so that one with that similarity collides with probability 1 - ``miss`` at least.

A window can only match if it contains a whole shingle of a template of its class. ``marks`` picks words so that each
shingle has one of them; texts with none of these are left out, then the places of all whole shingles are looked up, and
only windows around them are made: exact filters, not samples.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import materialise

#: Licence notices by name. A fixed list, in the wording in common use; pass others as ``templates``.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
}
SHINGLE = 5
#: Words of texts in a task.
TASK_WORDS = 500_000
#: A word: letters, digits and inner points.
WORD = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*+"
MATCHES = "doc_id long, template_id string, containment double, first_word long, n_words long, n_windows long"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower())


def shingle_count(words: int) -> int:
    return max(1, words - SHINGLE + 1) if words else 0


def window_words(words: int) -> int:
    """A quarter more than the template has, so that windows can overlap by less than all but one word; templates that
    are one short shingle get windows of just their length."""
    return words + words // 4 if words >= SHINGLE else words


def stride(words: int) -> int:
    """Every occurrence of a template lies within some window."""
    return window_words(words) - words + 1


def least_similarity(words: int, threshold: float) -> float:
    """Least Jaccard similarity of a template and a window that holds ``threshold`` of its shingles."""
    own, other = shingle_count(words), shingle_count(window_words(words))
    shared = math.ceil(threshold * own)
    return shared / (own + other - shared)


def bands(words: int, threshold: float, miss: float) -> int:
    """Bands of one value each, so that all but ``miss`` of the windows at the threshold collide in one of them."""
    s = least_similarity(words, threshold)
    return 1 if s >= 1 else math.ceil(math.log(miss) / math.log(1 - s))


def marks(templates: dict[str, str]) -> list[str]:
    """Words such that each shingle of each template has at least one: greedily, the word in most shingles first."""
    open_shingles = {tuple(w[i : i + SHINGLE]) for w in map(template_words, templates.values()) for i in range(shingle_count(len(w)))}
    chosen = []
    while open_shingles:
        count: dict[str, int] = {}
        for s in open_shingles:
            for w in set(s):
                count[w] = count.get(w, 0) + len(w)  # long words are rarer in texts
        best = min(count, key=lambda w: (-count[w], w))
        chosen.append(best)
        open_shingles = {s for s in open_shingles if best not in s}
    return chosen


def shingles_of(words: Column) -> Column:
    """The five-word shingles of an array of words; fewer words are one shingle, none are none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.when(n > 0, many).otherwise(F.array().cast("array<string>"))


def class_shingles(templates: dict[str, str]) -> dict[int, list[str]]:
    """By the number of words of a class, the shingles of its templates."""
    found: dict[int, set[str]] = {}
    for w in map(template_words, templates.values()):
        found.setdefault(len(w), set()).update(" ".join(w[i : i + SHINGLE]) for i in range(shingle_count(len(w))))
    return {n: sorted(x) for n, x in sorted(found.items())}


def hits(words: Column, size: int, known: list[str]) -> Column:
    """Where an array of words has one of the known runs of ``size`` words: structs of the place (from 0) and the run."""
    run = lambda i: F.array_join(F.slice(words, i + 1, size), " ")
    # most places are ruled out by their first word, without a string being made
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: words[i].isin(sorted({k.split(" ")[0] for k in known})) & run(i).isin(known))
    return F.when(F.size(words) >= size, F.transform(places, lambda i: F.struct(i.alias("place"), run(i).alias("run")))).otherwise(F.array().cast("array<struct<place:int,run:string>>"))


def first_words(found: Column, words: Column, n: int, known: list[str]) -> Column:
    """Where the windows of the class of ``n`` words begin that hold a shingle of the class: of 0, stride, 2 * stride and so
    on, up to the first window that reaches the text's end."""
    m, span, step = min(n, SHINGLE), window_words(n), stride(n)
    own = F.transform(F.filter(found, lambda x: x["run"].isin(known)), lambda x: x["place"])
    around = lambda p: F.sequence(F.floor(F.greatest(p + m - span + step - 1, F.lit(0)) / step), F.floor(p / step))
    begins = F.transform(F.array_distinct(F.flatten(F.transform(own, around))), lambda k: (k * step).cast("int"))
    return F.filter(begins, lambda f: f <= F.greatest(F.size(words) - span + step - 1, F.lit(0)))


def banded(frame: DataFrame, shingles: str) -> DataFrame:
    """A row for each band (0 to n_bands - 1) with the least value of the band's hash function over the shingles."""
    hashed = frame.withColumn("_hashed", F.transform(shingles, lambda s: F.xxhash64(s)))
    each = hashed.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("n_bands") - 1)))
    return each.withColumn("value", F.array_min(F.transform("_hashed", lambda h: F.xxhash64(h, F.col("band"))))).drop("_hashed", "n_bands")


def scan(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.75, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document and template that some window of the document holds ``threshold`` of: doc_id, template_id,
    containment (the most that a window has), first_word (where the first of these windows begins, from 0), n_words
    (in that window), n_windows (that hold the threshold).

    * Null and empty texts match nothing; neither do texts without words. A window at a text's end can be shorter.
    * A template of fewer than five words is a single shingle, the whole sequence; it is looked for in windows of as
      many words.
    * Repeated rows (same id and text) count once; of rows with one id and different texts, each is a row of its own.
    * Templates without words are ignored; no rows in, no rows out. Only the two columns named are read.
    """
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if template_words(v)}
    spark = df.sparkSession
    if not templates:
        return spark.createDataFrame([], MATCHES)
    pattern = "(?i)(?:" + "|".join(re.escape(w) for w in marks(templates)) + ")"
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(pattern)).distinct()
    read = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))
    # as a table, or the words would be read anew for each shingle
    read = materialise(read, "license-words")
    words = int(read.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"])
    # small tables come in few files, but windows are much work
    known_runs = class_shingles(templates)
    by_size: dict[int, set[str]] = {}
    for n, x in known_runs.items():
        by_size.setdefault(min(n, SHINGLE), set()).update(x)
    read = read.repartition(max(12, math.ceil(words / TASK_WORDS)), "text_hash")
    placed = read.select("*", *(hits(F.col("words"), m, sorted(x)).alias(f"hits_{m}") for m, x in by_size.items()))
    placed = materialise(placed.where(F.greatest(F.lit(0), *(F.size(f"hits_{m}") for m in by_size), F.lit(0)) > 0), "license-hits")

    cut = F.explode(
        F.array(*(F.struct(F.lit(n).alias("words_of_class"), F.lit(window_words(n)).alias("span"), F.lit(bands(n, threshold, miss)).alias("n_bands"), first_words(F.col(f"hits_{min(n, SHINGLE)}"), F.col("words"), n, x).alias("begins")) for n, x in known_runs.items()))
    )
    windows = (
        placed.select("doc_id", "text_hash", "words", cut.alias("c"))
        .select("doc_id", "text_hash", "words", "c.*")
        .select("doc_id", "text_hash", "words", "words_of_class", "n_bands", "span", F.explode("begins").alias("first_word"))
        .where(F.col("first_word") < F.size("words"))
        .select("doc_id", "text_hash", "words_of_class", "n_bands", "first_word", F.slice("words", F.col("first_word") + 1, F.col("span")).alias("window"))
        .withColumn("shingles", shingles_of(F.col("window")))
    )
    # a bounded table: one row for each template and band
    known = spark.createDataFrame([(k, len(w), bands(len(w), threshold, miss), w) for k, w in ((k, template_words(v)) for k, v in templates.items())], "template_id string, words_of_class int, n_bands int, template_words array<string>")
    known = known.select("template_id", "words_of_class", "n_bands", F.array_distinct(shingles_of(F.col("template_words"))).alias("template_shingles"))

    retrieved = (
        banded(windows, "shingles")
        .join(F.broadcast(banded(known, "template_shingles")), ["words_of_class", "band", "value"])
        .select("doc_id", "text_hash", "template_id", "first_word", F.size("window").cast("long").alias("n_words"), (F.size(F.array_intersect("shingles", "template_shingles")) / F.size("template_shingles")).alias("containment"))
        .where(F.col("containment") >= threshold)
    )
    found = retrieved.groupBy("doc_id", "text_hash", "template_id", "first_word").agg(F.first("n_words").alias("n_words"), F.first("containment").alias("containment"))
    return (
        found.groupBy("doc_id", "text_hash", "template_id")
        .agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"), "n_words")).alias("best"), F.count(F.lit(1)).alias("n_windows"))
        .select("doc_id", "template_id", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"), F.col("best.n_words").alias("n_words"), F.col("n_windows"))
    )


def oracle_sql(templates: dict[str, str] | None = None, threshold: float = 0.75) -> str:
    """The same rows without MinHash: template shingles found in the text, counted in the windows around them."""
    templates = TEMPLATES if templates is None else templates
    known = {(k, len(w), min(len(w), SHINGLE), " ".join(w[i : i + SHINGLE])) for k, v in templates.items() for w in [template_words(v)] for i in range(shingle_count(len(w)))}
    sizes = {k: sum(x[0] == k for x in known) for k in templates}
    rows = ", ".join(f"('{k}', {m}, {window_words(n)}, {stride(n)}, '{shingle}', {sizes[k]})" for k, n, m, shingle in sorted(known))
    return rf"""
        WITH known AS (SELECT * FROM (VALUES {rows}) v(template_id, m, span, step, shingle, size)),
        texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
        read AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:\.[\p{{L}}\p{{N}}]+)*') AS words FROM texts),
        placed AS (SELECT doc_id, md5(text) AS t, len(words) AS total, p, m, array_to_string(words[p + 1 : p + m], ' ') AS shingle
               FROM (SELECT *, unnest(range(len(words))) AS p FROM read), (SELECT DISTINCT m FROM known)),
        hits AS (SELECT doc_id, t, total, p, known.* FROM placed JOIN known USING (m, shingle) WHERE p + m <= total),
        windows AS (SELECT DISTINCT doc_id, t, total, template_id, span, size, shingle, w * step AS first_word
                    FROM (SELECT *, unnest(range(greatest(0, (p - span) // step), p // step + 1)) AS w FROM hits)
                    WHERE w * step <= p AND p + m <= w * step + span AND w * step <= greatest(total - span + step - 1, 0)),
        counted AS (SELECT doc_id, t, template_id, first_word, any_value(least(span, total - first_word)) AS n_words, count(*) / any_value(size) AS containment
                    FROM windows GROUP BY ALL HAVING count(*) / any_value(size) >= {threshold})
        SELECT doc_id, template_id, max(containment) AS containment, arg_min(first_word, (-containment, first_word)) AS first_word,
               CAST(arg_min(n_words, (-containment, first_word)) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_windows
        FROM counted GROUP BY doc_id, t, template_id"""
