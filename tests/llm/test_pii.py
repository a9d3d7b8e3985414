import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from docflow.llm.pii import find, sanitise

#: The base patterns, as plain as they come.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (p, ok) in checks.items() for m in re.finditer(p, text or "", re.A) if ok(m)]


ODD = [
    None, "", "no data here", "a@b.c", "mail x.y+z@sub.example.com.", "a@b.c_d@e.f", "é@x.yz ünï@a.b", "@a.b a@b", "x@y..z",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.255 1.2.3", "12345678.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111111111111112",
    "+1 (988) 555-2485, +44 20 7946 0958. +1", "+1+2 345 678 901", "🙂 +1 (988) 555-2485 漢 a@b.cd", "9" * 60, "a@b." + "c." * 5000 + "d",
    "7" * 20000, "a" * 30000 + "@", "x\ny@z.w\n\n1.1.1.1", "-.@-.-", "5555555555554444 4012888888881881", "1 2-3 4", "+1" + "()" * 3000 + "1",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(4, ODD[4]), (None, ODD[4]), (7, "other a@b.c")], "doc_id long, text string")


def test_base_spans_are_those_of_plain_patterns(odd):
    texts = [*ODD, ODD[4], ODD[4], "other a@b.c"]
    found = sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in find(odd).collect())
    expected = []
    for i, t in zip([*map(repr, range(len(ODD))), "4", "None", "7"], texts, strict=True):
        spans = brute(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((i, *(sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")), hashlib.sha256(said.encode()).hexdigest(), said))
    assert found == sorted(expected)


def test_terms_that_give_an_entity_away(spark):
    filler = [(100 + i, f"common words stand here and there number line {chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(400)]
    told = [(1, "the agent zorblax wrote from z@y.xw common words"), (2, "call zorblax at z@y.xw and there"), (3, "call zorblax at z@y.xw and there"), (4, "words common q@y.xw here"), (5, "here common q@y.xw there")]
    df = spark.createDataFrame(filler + told, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find(df).collect()}
    assert found[1] == "email:29:35,term:10:17" and found[2] == found[3] == "email:16:22,term:5:12"
    assert found[4] == "email:13:19" and found[5] == "email:12:18"
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert clean[1] == "the agent  wrote from [EMAIL] common words" and clean[4] == "words common [EMAIL] here" and clean[100] == filler[0][1]


def test_disclosing_terms_go_wherever_they_stand(spark):
    filler = [(100 + i, f"common words stand here and there number line {chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(400)]
    far = " ".join(f"w{chr(97 + i)}x" for i in range(15))
    told = [(1, "the agent zorblax wrote from z@y.xw common words"), (2, "call zorblax at z@y.xw and there"), (3, f"common words\nZorblax {far} zorblax"), (4, f"Zorblax {far} there z@y.xw words"), (5, "zorblax@other.example 7")]
    df = spark.createDataFrame(filler + told, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find(df).collect()}
    n = len(far)
    assert found[3] == f"term:13:20,term:{22 + n}:{29 + n}"
    assert found[4] == f"email:{15 + n}:{21 + n},term:0:7" and found[5] == "email:0:21" and found[100] == ""
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert not [t for t in clean.values() if "zorblax" in t.lower()] and clean[100] == filler[0][1]


def test_copies_of_one_line_prove_nothing(spark):
    filler = [(100 + i, f"line {chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(300)]
    df = spark.createDataFrame(filler + [(i, "only zorblax wrote z@y.xw") for i in range(5)], "doc_id long, text string")
    assert {r.spans for r in find(df).where("doc_id < 5").collect()} == {"email:19:25"}


def brute_spans(rows, disclosure=0.9, support=(2, 3, 5)):
    """All spans by the definition: distinct lines, every pair of an entity and a term counted one by one."""
    secret = re.compile(r"[=:][ \t]{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9+/_-]{19,})")
    words = lambda line: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", line)]
    spans = lambda line: brute(line) + [("secret", m.start(1), m.end(1)) for m in secret.finditer(line) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    lines = {line for _, t in rows for line in (t or "").split("\n") if t is not None}
    with_e, with_t, both = defaultdict(set), defaultdict(set), defaultdict(set)
    for line in lines:
        own, entities = spans(line), set()
        for kind, a, b in own:
            digits = re.sub("[^0-9]", "", line[a:b])
            value = digits if kind in ("card", "phone") else line[a:b] if kind == "secret" else line[a:b].lower()
            wide = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}.get(kind)
            entities |= {(0, kind, value), (2, kind)} | ({(1, kind, wide)} if wide else set())
        terms = {w for x, y, w in words(line) if not any(x < b and a < y for _, a, b in own)}
        for t in terms:
            with_t[t].add(line)
        for e in entities:
            with_e[e].add(line)
            for t in terms:
                both[e, t].add(line)
    n, told = len(lines), set()
    for (e, t), x in both.items():
        ic = math.log2(n / len(with_e[e]))
        if len(x) >= support[e[0]] and ic > 0 and math.log2(n * len(x) / (len(with_e[e]) * len(with_t[t]))) / ic >= disclosure:
            told.add(t)
    out = []
    for doc, text in rows:
        found, at = [], 0
        for line in (text or "").split("\n"):
            own = spans(line)
            free = [("term", x, y) for x, y, w in words(line) if w in told and not any(x < b and a < y for _, a, b in own)]
            found += [(k, a + at, b + at) for k, a, b in own + free]
            at += len(line) + 1
        rank = ["email", "ip", "card", "phone", "secret", "term"].index
        out.append((repr(doc), ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (rank(x[0]), x[1])))))
    return sorted(out), told


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_spans_are_those_of_plain_counts(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeghi") for _ in range(r.randint(2, 6))) for _ in range(60)]
    people = [(f"{w}@d{k % 3}.example", f"agent{w}xx") for k, w in enumerate("abc def gei".split())]
    rows = []
    for i in range(260):
        said = [r.choice(words) for _ in range(r.randint(1, 9))]
        kind = r.random()
        if kind < 0.2:
            mail, name = r.choice(people)
            said += [mail, name.upper() if r.random() < 0.2 else name]
        elif kind < 0.3:
            said += ["vouch", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(30)) + '"']
        elif kind < 0.4:
            said += [f"10.{r.randint(0, 2)}.{r.randint(0, 255)}.1", r.choice(["vialink", r.choice(words)])]
        elif kind < 0.42:
            said += ["agentabcxx", "vialink"]
        if kind < 0.5 or r.random() < 0.1:
            r.shuffle(said) if not 0.2 <= kind < 0.3 else None
        rows.append((i, " ".join(said) if r.random() < 0.9 else "\n".join(said)))
    rows += [(5, rows[5][1]), (None, rows[6][1]), (400, None), (401, "")]
    expected, told = brute_spans(rows)
    assert told
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((repr(x.doc_id), x.spans) for x in find(df).collect()) == expected


def test_secrets_and_the_word_before_them(spark):
    filler = [(100 + i, f"common words stand here and there number line {chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(400)]
    told = [(i, f'common {chr(97 + i)} token = "{i}ab{"0c9f" * 9}" and') for i in range(6)]
    df = spark.createDataFrame([*filler, *told, (50, "a token alone"), (51, "x = 1234567890123456789012")], "doc_id long, text string")
    found = {x.doc_id: x for x in find(df).collect()}
    assert found[1].spans == "secret:18:57,term:9:14" and (found[1].n_secret, found[1].n_term) == (1, 1)
    assert found[50].spans == "term:2:7" and found[51].spans == found[100].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert {x.doc_id: x.text for x in sanitise(df).collect()}[1] == 'common b [TERM] = "[SECRET]" and'


def test_columns_that_clash_keep_their_values(spark):
    df = spark.createDataFrame([(1, "a@b.cd 7", "c1", "k1", "t1", 9), (2, "none", "c2", "k2", "t2", None)], "doc_id long, text string, clean string, _clean string, text_key string, kind long")
    assert sorted(map(tuple, sanitise(df).collect())) == [(1, "[EMAIL] 7", "c1", "k1", "t1", 9), (2, "none", "c2", "k2", "t2", None)]


def test_sanitised_rows_keep_their_columns(odd, docs, rows):
    clean = sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    got = {r.doc_id: r.text for r in sanitise(odd).where("doc_id NOT IN (4, 7)").collect()}
    assert got[14] == ODD[14] if not brute(ODD[14]) else True
    assert got[13] == "[PHONE], [PHONE]. +1" and got[20] == "x\n[EMAIL]\n\n[IP]" and got[0] is None and got[1] == "" and got[2] == ODD[2]


def test_no_rows(no_docs):
    assert find(no_docs).count() == 0 and sanitise(no_docs).count() == 0
