"""SimHash near-dedup against brute force over all pairs of fingerprints."""

import random

import xxhash
from pyspark.sql import functions as F

from gridcast.llm import simhash
from gridcast.llm.queries import QUERIES


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint)."""
    parent = {f: f for _, f in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op1_simhash"](spark, sf).collect()), key=str)
    assert got == brute_components([(r[0], brute_fingerprint(r[1])) for r in docs])
    assert len({c for _, _, c in got}) < len(got)


def test_fingerprint_is_sparks_hash(spark):
    from gridcast.llm.simhash import fingerprint
    h = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert fingerprint(b"a B\tC") == h
    assert fingerprint(b"") == 0 and fingerprint(b" \n") == 0


def test_edge_rows(spark):
    rows = [(5, None, "x"), (3, "", "y"), (None, " ", "z"), (9, "one two", "x"), (9, "one two", "x"),
            (None, "alone in the world", "n"), (4, "w " * 30000, "x"), (2, "W\t" * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")       # fp clashes
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (None, 3), (9, 9), (None, None), (4, 2), (2, 2)}
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "9", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_dense_groups_link_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for base in list(fps)[:3]:
        cur = base
        for _ in range(60):
            for _ in range(rng.choice([1, 2, 3, 4])):
                cur ^= 1 << rng.randrange(20)
            fps.add(cur)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in simhash.links(frame).collect()}
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    from gridcast.llm.components import connected
    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(sorted(got), "a long, b long")).collect()}
    classes, ours = {}, {}
    for i, _, c in want:
        classes.setdefault(c, set()).add(i)
    for i, f in enumerate(signed):
        ours.setdefault(roots.get(f, f), set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, classes.values()))


def test_chain_components(spark):
    from gridcast.llm.components import connected
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["root"] for r in connected(edges).collect()} == {0}


def test_texts_that_share_an_id_stay_apart(spark):
    one, other = "alpha beta gamma delta epsilon zeta eta", "uno dos tres cuatro cinco seis siete ocho"
    docs = spark.createDataFrame([(1, one), (2, one), (1, other), (3, other), (1, one)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(docs).collect())
    assert got == [(1, one), (1, other)]
