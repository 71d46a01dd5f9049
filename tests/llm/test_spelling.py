"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

from gridcast.llm import spelling


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        near = [x for x in words if x != w and abs(len(x) - len(w)) < 2 and edits(w, x) == 1]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, form, root, n, near, form_n


def corpus(seed=1, docs=300):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé×", k=rng.randrange(3, 9))) for _ in range(90)]
    words += [w + rng.choice("abÿ") for w in words] + [w[1:] for w in words] + ["ŁódźXabcde", "ÀBCDEF", "aaaaab", "baaaaa"]
    rows = [(i, rng.choice([" ", "-", "\n", "λ", " "]).join(rng.choices(words, weights=[1 + 40 // (k + 1) for k in range(len(words))], k=rng.randrange(0, 40))))
            for i in range(docs)]
    return rows + [(None, "nameless words words words words nameless nameless"), (7, None), (8, ""), rows[0], rows[0], (11, "stayrz " * 3 + "stairz " * 7 + "stairs " * 20), (9, "x" * 300_000 + " longer" * 5)]


def test_variants_as_by_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS WORD", "2 AS n", "3 AS root")
    got = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = sorted(brute(rows), key=str)
    assert sorted(map(tuple, got), key=str) == want and any(w[1] and w[1] != w[2] for w in want)


def test_large_signature_groups_lose_no_pair(spark):
    words = [f"prefix{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    df = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n bigint")
    got = {(r["word"], r["other"]) for r in spelling.near_words(df, chunk=4).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and edits(a, b) == 1}


def test_near_words_share_a_signature():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choices("aabéz", k=rng.randrange(1, 12)))
        i, c = rng.randrange(len(a) + 1), rng.choice("abx")
        b = rng.choice([a[:i] + c + a[i:], a[:i] + c + a[i + 1:], a[:i] + a[i + 1:]])
        assert set(spelling.signatures(a)) & set(spelling.signatures(b)) or not b, (a, b)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
