"""Edge rows of the operators over documents, and brute force where SQL has no form."""

import random

import pytest
from pyspark.sql import functions as F

from gridcast.llm import decontaminate, language_id, line_dedup, mixing, quality, substring_dedup

SF = "/root/testdata/sf0.01"


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "One, TWO!"), (None, "one two"), (3, None), (4, "--"),
                                   (10, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b C d e f g h i j k y", "s"), (2, None, "s"), (3, "", "s"), (4, "one two one two", None),
                                  (4, "one two one two", None), (None, "é one é two", "s"), (6, "word " * 40000 + "one two", "s")],
                                 "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"])
                 for r in decontaminate.contamination(docs, bench).collect())
    assert got == [("1", 13, 11, [(1, 12)], ["1", "10"]), ("2", 0, 0, [], []), ("3", 0, 0, [], []),
                   ("4", 4, 4, [(0, 4)], ["2"]), ("4", 4, 4, [(0, 4)], ["2"]), ("6", 40002, 2, [(40000, 40002)], ["2"]),
                   ("None", 4, 0, [], [])]
    blocks = decontaminate.contamination(docs, bench, block_bytes=8)       # a pass per few items
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in blocks.collect()) == got
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.clean(docs, bench).count() == 3
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_line_dedup_edges(spark):
    line = "  A line of twenty chars\t"
    rows = [(1, line + "\nown"), (1, line.lower()), (2, "x\n" + line), (3, line.strip()), (None, line), (4, None), (5, ""),
            (6, "äöü short line 19 c\n\n"), (7, "äöü short line 19 c"), (8, "äöü short line 19 c")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, n_lines string")
    for bits in (line_dedup.MAX_BITS, 1 << 18):
        got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"])
                     for r in line_dedup.drop_repeated_lines(docs, max_bits=bits).collect())
        assert got == sorted([("1", "own", 2, 1), ("1", "", 1, 1), ("2", "x", 2, 1), ("3", line.strip(), 1, 0), ("None", line, 1, 0),
                              ("4", "", 1, 0), ("5", "", 1, 0), ("6", "äöü short line 19 c\n\n", 3, 0),
                              ("7", "äöü short line 19 c", 1, 0), ("8", "äöü short line 19 c", 1, 0)])


def test_filters_have_no_false_negatives():
    import numpy as np
    rng = np.random.default_rng(5)
    once, twice = rng.integers(0, 1 << 56, 3000).astype(np.uint64), rng.integers(0, 1 << 56, 500).astype(np.uint64)
    pair = line_dedup.FilterPair(1 << 14)
    pair.add(np.concatenate([once, twice]))
    pair.add(twice)
    seen = np.ones(500, bool)
    for place in line_dedup._bits(twice, pair.size):
        seen &= pair.twice[place]
    assert seen.all() and pair.twice.mean() < 0.5


def brute_repeats(texts, window):
    words = [[w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    where = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            where.setdefault(tuple(ws[i:i + window]), []).append((d, i))
    gone = {(d, i + k) for places in where.values() if len(places) > 1 for d, i in places for k in range(window)}
    return [" ".join(w for k, w in enumerate(ws) if (d, k) not in gone) for d, ws in enumerate(words)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_PIECES", hot)
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 60))] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [None, "", "a " * 300]
    for _ in range(25):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        texts.append(" ".join(a[:i] + b[j:]) + rng.choice(["", "\n", "\tend"]))
    docs = spark.createDataFrame([(i if i % 7 else None, t, "k") for i, t in enumerate(texts)] + [(1, texts[1], "k")],
                                 "doc_id long, text string, n_words string")
    texts.append(texts[1])
    for window in (12, 3):
        got = sorted(r["text"] for r in substring_dedup.remove_repeats(docs, window).collect())
        assert got == sorted(brute_repeats(texts, window))


def test_mix_is_whole_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.expr("nullif(source, 'src3')").alias("source"),
                                                                F.lit(1).alias("size"))
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    one, two = (mixing.mix(docs.repartition(n)).select("doc_id", "source", "size", "source_size", "target", "taken") for n in (3, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == docs.count()
    assert one.filter("taken > 2 * size OR (size > 0 AND taken % size <> 0)").count() == 0
    sums = one.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("s")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.2 * r["target"] and r["target"] <= 2 * r["s"] for r in sums)
    assert abs(sum(r["target"] for r in sums) - 1.5 * sum(r["s"] for r in sums)) < 1e-6


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(language_id.training_fold(docs))
    told = language_id.identify(docs.withColumn("held_out", language_id.held_out()), model)
    right, n, kept = told.filter("held_out AND length(text) > 100").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg((~F.col("rejected")).cast("int"))).first()
    assert right > 0.98 and n > 200 and kept > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "der die das und ist nicht mit"), (4, "der die das und ist nicht mit")],
                                "doc_id long, text string")
    got = [tuple(r)[2:] for r in language_id.identify(odd, model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0, True)] * 3 and got[3][0] == "de" and got[3] == got[4] and 0 <= got[3][1] <= 1
    nothing = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def brute_counts(text):
    import re
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    repeated = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


def test_quality_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(
        [(None, None), (-1, ""), (-2, "a b c d e a b c d e\n\n a \na\na"), (-3, "é # x\u00a0y\n" * 3)], docs.schema))
    field = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = sorted(map(tuple, quality.judge(docs, field, keep=["doc_id"]).drop("content_share", "kept").collect()), key=str)
    assert got == sorted([(r[0], *brute_counts(r[1])) for r in docs.collect()], key=str)


def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs, quality.learn(docs, labels), keep=["doc_id"]).join(labels, "doc_id").filter("NOT base_failed")
    by = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by[1] > 0.97 and by[0] < 0.3


def test_viterbi_equals_brute_force():
    import numpy as np
    from itertools import product
    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=quality.N_CODES), rng.normal(size=(2, 2)))

    def score(codes, labels):
        return sum(field.scores[c] for c, y in zip(codes, labels) if y) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))

    for n in range(1, 8):
        codes = rng.integers(0, quality.N_CODES, n).tolist()
        best = max(score(codes, ys) for ys in product([0, 1], repeat=n))
        assert abs(score(codes, [int(y) for y in field.content(codes)]) - best) < 1e-9
    assert field.content([]) == []


def test_lines_are_labelled_apart_from_their_document():
    """Boilerplate planted in good documents and content planted in bad ones are both found."""
    import random
    rng = random.Random(7)

    def content():
        return " ".join(rng.choices(["the", "river", "runs", "slowly", "past", "old", "mills", "and", "fields"], k=rng.randrange(9, 15)))

    def junk():
        return " ".join(rng.choices(["###", "%%%", "$$$", "BUY", "NOW", "&&&", "12345"], k=rng.randrange(4, 9)))

    docs = []
    for i in range(200):
        good = i % 2 == 0
        lines = [content() if good else junk() for _ in range(6)]
        lines.insert(rng.randrange(7), junk() if good else content())
        docs.append((lines, good))
    chains = [(quality.line_codes("\n".join(x).encode())[0], good) for x, good in docs[:120]]
    field = quality.fit_field([(c, y) for (c, _), y in zip(chains, quality.line_targets(chains))])
    right = total = mixed = 0
    for lines, good in docs[120:]:
        codes, sizes = quality.line_codes("\n".join(lines).encode())
        told = field.content(codes)
        share = sum(s for s, t in zip(sizes, told) if t) / sum(sizes)
        mixed += 0 < share < 1
        right += sum(t == ("river" in x or "the" in x or "mills" in x or "old" in x or "runs" in x) for t, x in zip(told, lines))
        total += len(lines)
    assert right / total > 0.95 and mixed > 70


def test_very_long_text_is_judged_whole(spark):
    rows = [(1, "good words of a line that goes on\n" * 60_000), (2, "x " * 500_000), (3, None)]
    field = quality.fit_field([])
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), field).collect()}
    assert got[1]["n_words"] == 480_000 and got[1]["n_dup_lines"] == 59_999 and got[2]["n_words"] == 500_000 and not got[3]["kept"]
