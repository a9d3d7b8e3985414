"""The stages on a small corpus: each works on all that the one before it kept, and its decisions take effect."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from docflow.llm.language_id import fit_on_training_rows, identify
from tests_llm_shared import brute_groups, norm


def test_stages(spark, docs, rows):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "jaccard_join", "pii", "best_fit_packing"]
    known = stages["language_id"](spark, docs, "").cache()
    assert known.columns == docs.columns
    rejected = identify(docs, fit_on_training_rows(docs)).where("rejected").count()
    assert known.count() == len(rows) - rejected and rejected >= 3

    distinct = stages["exact_dedup"](spark, known, "").cache()
    left = [(r.doc_id, r.text) for r in distinct.collect()]
    by_text = defaultdict(list)
    for r in known.collect():
        by_text[norm(r.text)].append(r.doc_id)
    assert distinct.columns == docs.columns and len(left) == len(by_text)
    assert all(d == min((x for x in by_text[norm(t)] if x is not None), default=None) for d, t in left)

    apart = stages["jaccard_join"](spark, distinct, "").cache()
    assert apart.columns == docs.columns
    stays = {d for d, least in brute_groups(left) if d is None or least is None or least >= d}
    assert sorted(map(repr, (r.doc_id for r in apart.collect()))) == sorted(repr(d) for d, _ in left if d is None or d in stays)

    clean = stages["pii"](spark, apart, "").cache()
    assert clean.columns == docs.columns and clean.count() == apart.count()
    assert not [r for r in clean.collect() if re.search(r"[a-z]@[a-z]+\.[a-z]", r.text or "")]

    packed = stages["best_fit_packing"](spark, clean, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    filled = defaultdict(int)
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def test_no_rows(spark, no_docs):
    frame = no_docs
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "")
        assert frame.count() == 0


def test_columns_that_clash_keep_their_values(spark):
    """Names that operators use inside, or have used, as columns of the documents."""
    names = ["score", "rejected", "lang_pred", "_clean", "clean", "text_key", "_sha", "sha", "_nth", "same", "keep_id", "gone", "_gone", "component_id", "set_id"]
    words = {"en": "the and of to is that it was for on are as with his they".split(), "de": "und der die das nicht ist ein zu mit auf sich des".split()}
    r = random.Random(5)
    texts = [(" ".join(r.choice(words[lang]) for _ in range(30)) + f" w{chr(97 + i % 26)}{chr(97 + i // 26)}", lang) for i, lang in enumerate(["en", "de"] * 40)]
    rows = [(i, t, lang, "s", len(t), *(f"{n} {i}" for n in names)) for i, (t, lang) in enumerate(texts)]
    rows += [(100, texts[0][0], "en", "s", 1, *names), (101, texts[1][0] + " more", "de", "s", 1, *names), (102, "they are with me@mail.example and it was", "en", "s", 1, *(f"{n} 102" for n in names))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        left = frame.collect()
        assert len(left) > 60 and all(r[n] == f"{n} {r.doc_id}" for r in left if r.doc_id not in (100, 101) for n in names)
        frame = spark.createDataFrame(left, frame.schema)
    assert not {100, 101} & {r.doc_id for r in left} and [r.text for r in left if r.doc_id == 102] == ["they are with [EMAIL] and it was"]
    assert stage_columns(corpus_pipeline.STAGES[-1][1](spark, frame, "")) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def stage_columns(frame):
    return frame.columns


def test_run_is_the_stages(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50


def test_python_stages_get_small_batches(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:3] + corpus_pipeline.STAGES[4:]:
            spark.conf.set(key, "10000")
            stage(spark, docs.limit(3), "")
            assert int(spark.conf.get(key)) == 1_000
    finally:
        spark.conf.set(key, before)
