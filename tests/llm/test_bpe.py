import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from docflow.llm import bpe

PATHS = [P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.replay_of(path).ranks, special_tokens={})


@pytest.mark.parametrize("path", PATHS)
def test_ids_are_those_of_the_library(path):
    r = random.Random(2)
    texts = ["", "aaaaaaaaaaa", "x" * 3000, "  a  b ", "it's we'll", "\x1c a\x1c b", "漢字 かな", "🙂🙂 🙂", "\x00 a", "-" * 50, " " * 90 + "x", "a b　c", "<|endoftext|>"]
    texts += ["".join(r.choice("ab cé\n .'s1 漢!Zz-") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    _, ids, docs = bpe.encode_block(texts, bpe.replay_of(path), bpe.splitter(P.PATTERN))
    assert [[i for w in d for i in ids[w]] for d in docs] == [library(path).encode_ordinary(t) for t in texts]


def test_lower_ranks_go_first():
    """Merging ab makes abc possible, which has a lower rank than ab: it must come before the second ab."""
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257, b"ca": 258, b"cab": 259}
    text = "abcabab xabcab abababc"
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(ranks)
    _, ids, docs = bpe.encode_block([text], replay, bpe.splitter(P.PATTERN))
    assert [i for w in docs[0] for i in ids[w]] == enc.encode_ordinary(text)


def test_digests_and_round_trip(docs, rows):
    enc = library(PATHS[0])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = sorted(((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in rows for ids in [enc.encode_ordinary(t or "")]), key=repr)
    assert sorted((tuple(r) for r in bpe.encode_digests(docs, PATHS[0], P.PATTERN).collect()), key=repr) == expected
    back = bpe.decode(bpe.encode(docs, PATHS[0], P.PATTERN), PATHS[0])
    assert sorted((repr(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted((repr(d), (t or "").encode()) for d, t in rows)


def test_blocks_change_nothing(docs):
    work = lambda texts: [__import__("pyarrow").array([len(texts)] * len(texts))]
    sizes = {r.n for r in bpe._by_block(docs, "doc_id", "text", "n long", work, block_bytes=200).collect()}
    assert max(sizes) < 40


def test_no_rows(no_docs):
    assert bpe.encode_digests(no_docs, PATHS[0], P.PATTERN).count() == 0
