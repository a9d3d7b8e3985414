"""Small corpora: words of few kinds, copies, near copies, shared passages, nulls, empty, odd and long texts."""

import random

import pytest

#: Columns with names that the operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `set_id` long, `_sha` string, `key` string, `n` long, `line` string"


def corpus(seed: int, n: int = 160) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = ["".join(r.choice("aeinorst") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(30))
    texts: list[str | None] = [None, "", " \n\t ", "a", "one two three four", "Ünï çødé 漢字 🙂", "x" * 500, "ab " * 400, "\u0000 nul \u0000"]
    while len(texts) < n:
        kind = r.random()
        long = r.choice([3, 8, 30, 60, 120])
        text = " ".join(r.choice(words) for _ in range(long)) + r.choice([".", "\n", ""])
        if kind < 0.15 and texts[-1]:
            text = r.choice([t for t in texts if t])
        elif kind < 0.5:
            base = r.choice([t for t in texts if t]).split(" ")
            for _ in range(r.randint(1, 3)):
                base[r.randrange(len(base))] = r.choice(words)
            text = " ".join(base)
        elif kind < 0.7:
            text = f"{text} {passage} {r.choice(words)}"
        elif kind < 0.75:
            text = text.upper().replace(" ", "  ")
        texts.append(text)
    texts.append(" ".join(r.choice(words) for _ in range(4000)))
    ids = r.sample(range(10_000), len(texts))
    rows: list[tuple[int | None, str | None]] = list(zip(ids, texts, strict=True))
    return rows + [rows[20], rows[20], (rows[30][0], "another text under the same id " * 4), (None, rows[12][1]), (None, "no id " * 30)]


@pytest.fixture(scope="session", params=[1, 2])
def rows(request):
    return corpus(request.param)


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en" if k % 3 else None, f"s{k % 2}", None, k, "x", "y", k, "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, CLASHING).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)
