import hashlib
import re
from collections import Counter

from docflow.llm.exact_dedup import drop_copies, exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    ids, size = {}, Counter(norm(t) for _, t in rows)
    for d, t in rows:
        if d is not None:
            ids[norm(t)] = min(ids.get(norm(t), d), d)
    seen, out = set(), []
    for d, t in rows:
        keep = ids.get(norm(t))
        kept = d == keep and (d, norm(t)) not in seen
        seen.add((d, norm(t)))
        out.append((d, keep, size[norm(t)], kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(docs, rows):
    assert sorted((tuple(r) for r in exact_dedup(docs).collect()), key=repr) == brute(rows)


def test_rows_kept(docs, rows):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((repr(r.doc_id), norm(r.text)) for r in kept.collect()) == sorted((repr(d), next(norm(t) for _, t in rows if hashlib.sha256(norm(t).encode()).hexdigest() == sha)) for d, _, _, k, sha in brute(rows) if k)


def test_one_text_in_all_rows(spark):
    df = spark.range(0, 3000).selectExpr("id AS doc_id", "'same  text' AS text").repartition(20)
    rows = exact_dedup(df).collect()
    assert len(rows) == 3000 and {(r.keep_id, r.group_size) for r in rows} == {(0, 3000)} and sum(r.kept for r in rows) == 1


def test_hot_texts_are_salted(docs, rows):
    """With a bound of two rows several texts are hot, so their contents meet again in the global stage."""
    assert sorted((tuple(r) for r in exact_dedup(docs, hot_rows=2).collect()), key=repr) == brute(rows)
    assert sorted(repr(r.doc_id) for r in drop_copies(docs, hot_rows=2).collect()) == sorted(repr(r.doc_id) for r in drop_copies(docs).collect())


def test_columns_that_clash_keep_their_values(spark):
    df = spark.createDataFrame([(1, "a", "s1", "k1", 7, "w1"), (2, "a", "s2", "k2", 8, "w2"), (3, "b", "s3", "k3", 9, None), (3, "b", "s3", "k3", 9, None)], "doc_id long, text string, sha string, keep_id string, same long, _sha string")
    assert sorted(map(tuple, drop_copies(df).collect())) == [(1, "a", "s1", "k1", 7, "w1"), (3, "b", "s3", "k3", 9, None)]


def test_no_rows(no_docs):
    assert exact_dedup(no_docs).count() == 0 and drop_copies(no_docs).count() == 0
