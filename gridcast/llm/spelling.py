"""Spelling variants of a corpus's words, found by PartEnum signatures.

Words are counted over all texts. A word's letters are a multiset, seen as a binary vector over
(letter, which occurrence); an inserted, deleted or replaced letter changes at most two of its
dimensions. Dimensions are dealt to ``PARTS = 4`` parts; vectors at distance two or less agree
on at least two whole parts, so they share one of the 6 choices of two parts. Anagrams share all
of them, so a signature also takes in half of the spelling: one edit leaves the first or the
last half of the shorter word as it is. Each word gives 24 signatures of 64 bits; words meet by
an equi-join on them and are verified by edit distance. A signature of more than ``CHUNK`` words
is dealt over several tasks, none of which lists pairs that are not near.

A word's form is the most frequent of its near words (ties: the least in code-point order) if
that is at least twice as frequent; forms are followed to the last by pointer doubling, at most
six rounds, as counts double along a chain.

Defined results: NULL and empty texts have no words; very long texts are read whole; repeated
rows count each; a NULL ``doc_id`` is written as nothing before the colon of the typo rule;
an empty table gives no words. Only ``doc_id`` and the text are read, so further columns of any
name change nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridcast.functions.scale_out import lookup_join, settle, spread
from gridcast.llm.common import slices

MIN_CHARS, MIN_COUNT, TYPO = 5, 3, 97
PARTS, SAME = 4, 2
CHUNK = 1024
_MASK = (1 << 64) - 1
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_SPLIT).split()


def written(run: bytes, prefix: int) -> bytes:
    """The run as it counts for a document: one letter less if the hash says so. ``prefix`` is the
    CRC of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % TYPO:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of words long and frequent enough. A slice of texts is counted before its
    words are shuffled."""
    def run(batches):
        for batch in slices(batches, "_text", 8 << 20):
            counts: Counter[bytes] = Counter()
            for name, t in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                prefix = zlib.crc32(name.encode() + b":")
                for r, n in Counter(runs(t)).items():
                    if len(r) >= min_chars and len(w := written(r, prefix)) >= min_chars:
                        counts[w] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    read = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                                                       F.col(text).alias("_text"))
    return read.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") >= min_count)


def _mix(x: int) -> int:
    """64 well-mixed bits."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def halves(word: str) -> list[tuple[int, int, str]]:
    """(length of the shorter word, side, half): two words one edit apart share one of these."""
    out = []
    for m in (len(word), len(word) - 1):
        h = m // 2
        out += [(m, 0, word[:h]), (m, 1, word[len(word) - (m - h):])]
    return out


def signatures(word: str, parts: int = PARTS, same: int = SAME) -> list[int]:
    """Signed 64-bit signatures."""
    sums, seen = [0] * parts, Counter()
    for c in word:
        element = _mix(ord(c) << 20 | seen[c])
        seen[c] += 1
        sums[element % parts] += element
    sides = [zlib.crc32(half.encode()) << 8 | m << 1 & 0xFE | side for m, side, half in halves(word)]
    out = []
    for i, choice in enumerate(combinations(range(parts), same)):
        vector = i
        for p in choice:
            vector = _mix(vector ^ sums[p] & _MASK)
        out += [_mix(vector ^ s) for s in sides]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _signed(words: DataFrame) -> DataFrame:
    """``(sig, word, n)``."""
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                sigs = [signatures(w) for w in part.column("word").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(sigs)), [len(s) for s in sigs]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs), pa.int64()), part.column("word").take(at),
                                                  part.column("n").take(at)], ["sig", "word", "n"])

    return spread(words.select("word", "n"), "word").mapInArrow(run, "sig bigint, word string, n bigint")


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(word, n, other, other_n)``: both directions of every pair of ``words (word, n)`` one edit apart."""
    signed = settle(_signed(words))
    shared = signed.groupBy("sig").agg(F.count("*").alias("members")).filter("members > 1") \
        .select("sig", F.ceil(F.col("members") / chunk).cast("int").alias("salts"))
    met = settle(signed.join(shared, "sig"))
    left = met.select("sig", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int").alias("salt"), "word", "n")
    right = met.select("sig", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                       F.col("word").alias("other"), F.col("n").alias("other_n"))
    one_edit = (F.col("word") < F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    same = (left["sig"] == right["sig"]) & (left["salt"] == right["salt"])
    pairs = settle(left.join(right.hint("merge"), same & one_edit).select("word", "n", "other", "other_n").distinct())
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form, by pointer doubling."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = settle(lookup_join(now, on, "root", "left", salt_by="word")
                       .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word."""
    words = settle(word_counts(docs, text, min_chars, min_count))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                   F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best")))
    known = known.select("word", F.col("best.form").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n"))
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
