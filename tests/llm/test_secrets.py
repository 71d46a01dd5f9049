"""Secret scans against plain rules over all pairs of parts, planted credentials and edge cases."""

import random
import re
import time

from gridcast.llm import secrets


def brute(text):
    base = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24]
    weak = [w for w in secrets.candidates(text, []) if not any(a < w[2] and b > w[1] for _, a, b in base)]

    def linked(w, kinds):
        for k, a, b in base + weak:
            gap = (b, w[1]) if b <= w[1] else (w[2], a)
            if k in kinds and 0 <= gap[1] - gap[0] <= 200 and not re.search(r"\n[\x20\t\r]*\n", text[gap[0]:gap[1]]):
                return True
        return False

    secret, identifier = ("assign", "hex", "key"), ("access", "id")
    told = [w for w in weak if all(linked(w, kinds) for kinds in
            {"id": (secret,), "key": (identifier,), "endpoint": (secret, identifier)}[w[0]])]
    return base, sorted(base + told, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def test_random_texts_as_by_all_pairs():
    rng = random.Random(3)
    pieces = ["user=bob ", "login: anna ", "pwd = hunter22 ", "KEY:abcd ", "host=db1.example ", "https://api.example.com/x ",
              "AKIA" + "Q7" * 9 + " ", "a1" * 13 + " ", "token = 'abcdef99' ", "token=abc ", "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 ", "\n", "\n \n", "é",
              "x" * 90 + " ", "y " * 60, "secret=token =abcdef ", "ſecret=abcdefg "]
    for _ in range(600):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 25)))
        base = secrets.base_spans(text)
        want_base, want = brute(text)
        assert sorted(base) == sorted(want_base) and secrets.in_order(base + secrets.linked(text, base)) == want, text


def kinds(text):
    base = secrets.base_spans(text)
    return [k for k, _, _ in secrets.in_order(base + secrets.linked(text, base))]


def test_weak_parts_alone_are_left():
    assert kinds("user=bob wrote to https://example.com about it") == []
    assert kinds("pass: rivers\n\nuser: bob1") == []                     # other scope
    assert kinds("user: bob1" + " " * 300 + "pass: rivers") == []        # out of reach


def test_complementary_parts_are_linked():
    assert kinds("user: bob1\npass: rivers\nhost: db.example") == ["id", "key", "endpoint"]
    assert kinds("login=root token=0123abcd") == ["id", "assign"]
    assert kinds("https://x.example AKIA" + "A1" * 8 + " Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9") == ["endpoint", "access", "key"]


def test_very_long_texts_in_time():
    start = time.time()
    for text in ("a" * 3_000_000, "token " * 400_000, "user" * 500_000, "\n" * 2_000_000, "user=bob pwd=secrets " * 100_000):
        base = secrets.base_spans(text)
        secrets.linked(text, base)
    assert time.time() - start < 60


def test_rows_and_clashing_columns(spark):
    text = "user=bob pwd=rivers token=0123abcd"
    docs = spark.createDataFrame([(1, text, 5, "z"), (1, text, 5, "z"), (None, None, 6, None), (3, "", 7, "")],
                                 "doc_id bigint, text string, SPANS int, `n.hex` string")
    got = secrets.scan(docs).orderBy("doc_id").collect()
    assert [r["n_assign"] for r in got] == [0, 1, 1, 0] and [len(r["spans"]) for r in got] == [0, 3, 3, 0]
    assert "SPANS" not in got[0].asDict() and got[1]["n.hex"] == "z"
    assert secrets.scan(docs.limit(0)).count() == 0
