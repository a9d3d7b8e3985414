import random

import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from docflow.llm.language_id import BLOCK_BYTES, RUN_UP_BYTES, RUN_UPS, SEARCH, SHORT_BYTES, UNKNOWN, Model, classify, dictionary, drop_rejected, fit, fit_on_training_rows, identify, is_held_out, margin_of, prepared

SYLLABLES = {"a": "ba be bi bo bu ta te ti".split(), "b": "zor kex vim qul wyn jax puk dril".split(), "c": "éla ôri ùme çan ïlo äre öst".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    rows = [(i, text(r, lang, r.choice([20, 200, 2000])), lang) for i, lang in enumerate(r.choice("abc") for _ in range(400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(labelled):
    found = identify(labelled, fit_on_training_rows(labelled)).join(labelled, "doc_id").where(is_held_out()).collect()
    assert len(found) > 80
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95
    assert sum(r.rejected for r in found) / len(found) < 0.05
    assert all(0 <= r.score <= 1 for r in found)


def plain_choice(text, model):
    """The method without blocks' and workers' plumbing: one call of the compressor for each piece and language."""
    data = prepared(text).encode()
    sizes = {}
    for lang, content in model.dictionaries:
        params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        if len(data) < SHORT_BYTES:
            starts = [content[i : i + RUN_UP_BYTES] + b" " for i in range(0, len(content), len(content) // RUN_UPS + 1)]
            sizes[lang] = sum(len(coder.compress(x + data)) - len(coder.compress(x)) for x in starts)
        else:
            sizes[lang] = sum(len(coder.compress(data[i : i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES))
    first, second = sorted(sizes.values())[:2]
    return min(sizes, key=lambda x: (sizes[x], x)), (second - first) / max(1, first) <= model.margin


def test_choices_are_those_of_a_plain_coder(labelled):
    model = fit_on_training_rows(labelled)
    texts = {r.doc_id: r.text for r in labelled.collect()}
    for r in identify(labelled, model).collect():
        assert (r.lang_pred, r.rejected) == plain_choice(texts[r.doc_id], model)


def test_labels_of_held_out_rows_and_other_columns_dont_matter(labelled):
    other = labelled.withColumn("lang", F.when(is_held_out(), "z").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert fit_on_training_rows(labelled) == fit_on_training_rows(other)
    model = fit_on_training_rows(labelled)
    moved = other.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    assert {(r.doc_id + 1000, r.lang_pred, r.score) for r in identify(labelled, model).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in identify(moved, model).collect()}


def test_narrow_choices_are_rejected(labelled):
    model = fit_on_training_rows(labelled)
    assert 0 < model.margin < 0.2
    r = random.Random(9)
    half = lambda: " ".join(text(r, x, 1) for _ in range(300) for x in "ab")
    lead = [classify(half(), model) for _ in range(20)]
    clear = [classify(text(r, "a", 300), model) for _ in range(20)]
    assert not any(x[2] for x in clear)
    assert margin_of(model.dictionaries, [("a", half()) for _ in range(50)]) < 0.1
    assert sum(classify(half(), Model(model.dictionaries, 0.1))[2] for _ in range(20)) >= sum(x[2] for x in lead)


def test_every_training_text_has_its_share():
    parts = dictionary([chr(97 + k) * 500 for k in range(10)] + ["zz"], 1000).decode().split("\n")
    assert {x[:1] for x in parts if x} == set("abcdefghijz") and max(map(len, parts)) < 110


def test_odd_rows(docs, rows):
    model = Model((("x", b"some text of a language " * 20), ("y", b"quite another one it is " * 20)), 0.0)
    found = identify(docs, model)
    assert found.columns == ["doc_id", "lang_pred", "score", "rejected"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = [r for r in found.collect() if r.doc_id not in (rows[30][0], None)]
    assert found.count() == len(rows)
    for r in got:
        r = Row(text=texts[r.doc_id], **r.asDict())
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == (UNKNOWN, 0.0, True)
        else:
            assert r.lang_pred in ("x", "y")


def test_ties_are_rejected():
    same = (("x", b"abc " * 50), ("y", b"abc " * 50))
    assert classify("abc abc", Model(same, 0.0)) == ("x", 0.5, True)
    assert classify("abc", Model((), 0.0)) == (UNKNOWN, 0.0, True)
    assert classify("abc", Model((("x", b"abc " * 50),), 0.0)) == ("x", 1.0, False)


def test_nothing_to_learn_from(no_docs):
    assert fit(no_docs) == Model((), 0.0)
    assert identify(no_docs, fit(no_docs)).count() == 0 and drop_rejected(no_docs, fit(no_docs)).count() == 0


def test_columns_that_clash_keep_their_values(spark):
    model = Model((("x", b"some text of a language " * 20), ("y", b"quite another one it is " * 20)), 0.0)
    df = spark.createDataFrame([(1, "some text of a language", 0.5, True, "p", "t"), (2, "1 2", 0.1, None, "q", "u")], "doc_id long, text string, score double, rejected boolean, lang_pred string, text_in string")
    assert list(map(tuple, drop_rejected(df, model).collect())) == [(1, "some text of a language", 0.5, True, "p", "t")]


def test_long_texts_count_throughout():
    r = random.Random(1)
    models = tuple((lang, text(r, lang, 500).encode()) for lang in "ab")
    assert classify(text(r, "a", 500) + " " + text(r, "b", 5000), Model(models, 0.0))[0] == "b"


def test_texts_are_sent_once(labelled):
    model = fit(labelled)
    found = drop_rejected(labelled, model)
    assert "text_in" not in found._jdf.queryExecution().analyzed().toString()
    kept = {r.doc_id for r in identify(labelled, model).where("not rejected").collect()}
    assert kept and sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in labelled.collect() if r.doc_id in kept)


def test_a_field_of_a_column_can_be_the_text(labelled):
    model = fit(labelled)
    nested = labelled.select("doc_id", F.struct("text").alias("of"))
    assert {r.doc_id for r in drop_rejected(nested, model, "of.text").collect()} == {r.doc_id for r in drop_rejected(labelled, model).collect()}
