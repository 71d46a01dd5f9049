"""SimHash near-dedup over pigeonhole blocks.

A fingerprint of 64 bits is cut into ``BLOCKS = 6`` blocks. Two fingerprints that differ in at
most 3 bits agree on at least 3 whole blocks, so they share one of the 20 choices of 3 blocks
(about 32 bits each: far more telling than one block of 16 bits). Fingerprints, not documents,
meet on these keys: exact copies are one node. Within a key, few members are compared pair by
pair. More than ``PAIRWISE`` are dealt to chunks; each pair of chunks is compared in one task of
bounded size that gives only the links of a spanning forest, never all pairs.

Defined results: NULL and empty texts have fingerprint zero and link like any other; very long
texts are fingerprinted whole; a bit set in exactly half of the hashes is 0. Repeated rows share a
fingerprint. Rows without ``doc_id`` take part; a component of only such rows has a NULL id. An
empty table gives no rows. Input columns named ``fp`` or ``component_id``, in any case of letters,
give way to the results.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.functions.scale_out import settle
from gridcast.llm.common import map_texts, utf8
from gridcast.llm.components import connected

WORDS, SEED, MAX_BITS = 3, 42, 3
BLOCKS = 6
PAIRWISE, CHUNK = 48, 2048
FIELD = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: bytes) -> int:
    """Signed 64 bits; a bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    n = min(WORDS, len(words))
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b - 1], SEED) for a, b in zip(ends, ends[n:])), np.uint64, len(words) - n + 1)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a signed 64-bit ``fp``."""
    return map_texts(docs, lambda batch: ([fingerprint(t) for t in utf8(batch, text)],), FIELD, keep, text=text)


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Signed masks that keep all but ``max_bits`` of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from each close fingerprint of a pair of chunks to the least one it reaches."""
    fps = np.unique(pdf["fp"].to_numpy(np.int64))
    blocks = [slice(i, i + 256) for i in range(0, len(fps), 256)]          # bounds the wide intermediates
    close = np.zeros((len(fps), len(fps)), bool)
    for b in blocks:
        close[b] = np.bitwise_count(fps[b, None] ^ fps) <= MAX_BITS
    label = np.arange(len(fps))
    while True:
        new = np.concatenate([np.where(close[b], label, len(fps)).min(axis=1) for b in blocks])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(fps))
    return pd.DataFrame({"a": fps[far], "b": fps[label[far]]})


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``(a, b)``: links enough to connect all of the distinct ``fps`` that differ in few bits."""
    masks = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
             for i, m in enumerate(block_masks(blocks, max_bits))]
    keyed = fps.select("fp", F.explode(F.array(*masks)).alias("k")).select("fp", "k.choice", "k.bits")
    shared = settle(keyed.groupBy("choice", "bits").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    found = shared.filter("n = 2").select("a", "b").filter(near)

    members = keyed.join(shared.filter("n > 2").select("choice", "bits", "n"), ["choice", "bits"])
    few = members.filter(F.col("n") <= PAIRWISE).groupBy("choice", "bits").agg(F.collect_list("fp").alias("m"))
    few = few.select(F.explode("m").alias("a"), "m") \
        .select("a", F.explode(F.expr(f"filter(m, x -> x > a AND bit_count(x ^ a) <= {max_bits})")).alias("b"))

    chunks = F.ceil(F.col("n") / CHUNK)
    many = members.filter(F.col("n") > PAIRWISE) \
        .withColumn("own", F.pmod(F.xxhash64("fp"), chunks)) \
        .withColumn("other", F.explode(F.expr(f"sequence(0L, ceil(n / {CHUNK}) - 1)"))) \
        .select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    many = many.groupBy("choice", "bits", "i", "j").applyInPandas(_forest, "a bigint, b bigint")
    return found.unionByName(few).unionByName(many).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp`` and ``component_id``, the least ``doc_id`` reachable over links."""
    marked, classes = _components(docs, text, keep)
    return marked.join(classes.drop("root"), "fp")


def _components(docs: DataFrame, text: str, keep: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Fingerprinted rows, and ``(fp, root, component_id)``."""
    marked = settle(fingerprints(docs.drop("component_id"), text, keep))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, rooted.join(least, "root").select("fp", "root", "component_id")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each component: that with the least ``(doc_id, fp)``.

    Rows without ``doc_id`` go only where a document of their component stays; a component of
    only such rows keeps them all.
    """
    marked, classes = _components(docs, text, ["doc_id"])
    named = marked.join(classes, "fp")
    kept = settle(named.filter("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("fp")))
    # A doc_id of several texts: only these rows are told apart by their fingerprints, read again.
    shared = settle(marked.filter("doc_id IS NOT NULL").groupBy("doc_id")
                    .agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id"))
    stay = docs.join(kept.join(shared, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi") \
        .select(*docs.columns).dropDuplicates(["doc_id"])
    if not shared.isEmpty():
        rows = docs.join(shared, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("_row"), text)
        several = fingerprints(rows, text, ["_row"]).withColumn("doc_id", F.col("_row.doc_id")) \
            .join(kept.select("doc_id", "fp"), ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id", "fp"])
        stay = stay.unionByName(several.select("_row.*"))
    nameless = named.filter("component_id IS NULL").select("fp").distinct()
    whole = docs.filter("doc_id IS NULL").select(F.struct("*").alias("_row"), text)
    lost = fingerprints(whole, text, ["_row"]).join(nameless, "fp", "left_semi").select("_row.*")
    return stay.unionByName(lost)
