"""Substring dedup by a compressed FM-index per shard.

A window of ``WINDOW`` words is repeated if its words also start anywhere else, in another
document or the same one. Shards are dealt by content, so that equal windows always meet:

1. Every window is anchored at its least ``ANCHOR``-gram by hash. Neighbouring windows with one
   anchor form a piece (under twice a window long). Only anchors, numbers of 8 bytes, leave the
   task; an anchor that occurs once in the corpus cannot stand in a repeated window.
2. Pieces with a repeated anchor are cut out of their documents and equal ones added up.
3. A shard indexes its distinct pieces. Each piece is streamed through the index by backward
   search; the matching statistics tell which of its windows have a second occurrence.
4. Repeated windows become word spans of the documents and are removed.

An anchor with more than ``HOT_PIECES`` distinct pieces is taken apart: its windows, equal ones
added up, are dealt to shards by their own hash, so no anchor outgrows a shard.

Defined results: a NULL or empty text has no words; very long texts are searched whole. Rows are
occurrences of their own: repeated rows repeat all their windows. Of equally small 8-grams the
first is the anchor, which decides where a window is looked up but not whether it is found.
Windows are judged on the input, not on what is left of it. An empty table gives no rows. The
user's columns travel in one struct, so any names are fine; one named like a result gives way to
it, in any case of letters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.functions.scale_out import fits_broadcast, settle
from gridcast.llm.common import BOX, box, joined, map_texts, partitions, unbox, utf8
from gridcast.llm.fm_index import FMIndex

WINDOW, ANCHOR = 35, 8
SHARD_BYTES = 2 << 20                 # of distinct pieces in one index
SLICE_BYTES = 2 << 20                 # of text taken apart at a time
HOT_PIECES = 4096
LONGS, INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
KEY = ["_gc_id", "_gc_hash"]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def pieces(words: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``(text, anchor, start, windows)`` of all pieces, in order."""
    flat, ends = joined(words)
    k = min(ANCHOR, window)
    n = len(flat) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    hashes = np.fromiter(map(_Hashes().__getitem__, flat), np.uint64, len(flat))
    gram = np.zeros(len(flat) - k + 1, np.uint64)
    for i in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(gram) + i]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.uint64((1 << 26) - 1)
    at = (_least((gram & ~place) | (np.arange(len(gram)).astype(np.uint64) & place), window - k + 1) & place).astype(np.int64)
    start = np.arange(n)
    at += (start - at + (1 << 25)) >> 26 << 26                # places beyond 2^26 words
    doc = np.repeat(np.arange(len(words)), np.diff(ends))
    inside = np.flatnonzero(doc[:n] == doc[window - 1:])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4
    first = np.flatnonzero(np.concatenate([[True], (at[inside[1:]] != at[inside[:-1]]) | (doc[inside[1:]] != doc[inside[:-1]])]))
    start = inside[first]
    return (doc[start], gram[at[start]].view(np.int64), start - ends[doc[start]],
            np.diff(np.concatenate([first, [len(inside)]])))


def _per_text(n: int, text: np.ndarray, *values: np.ndarray) -> list[list]:
    cuts = np.searchsorted(text, np.arange(1, n))
    return [np.split(v, cuts) for v in values]


def _anchored(docs: DataFrame, window: int) -> DataFrame:
    """``(*KEY, anchor, start, n)``, one row per piece."""
    def find(batch):
        text, anchor, start, n = pieces([t.split() for t in utf8(batch, "_gc_text")], window)
        return _per_text(batch.num_rows, text, anchor, start.astype(np.int32), n.astype(np.int32))

    fields = T.StructType([T.StructField("anchor", LONGS), T.StructField("start", INTS), T.StructField("n", INTS)])
    found = settle(map_texts(docs, find, fields, KEY, SLICE_BYTES, "_gc_text").filter("size(anchor) > 0"))
    return found.select(*KEY, F.explode(F.arrays_zip("anchor", "start", "n")).alias("p")).select(*KEY, "p.*")


def _cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(*KEY, anchor, start, words)`` of the ``wanted (anchor, start, n)`` per document."""
    def cut(batch):
        out = []
        for t, want in zip(utf8(batch, "_gc_text"), batch.column("want").to_pylist()):
            words = t.split()
            out.append([{"anchor": w["anchor"], "start": w["start"],
                         "words": b" ".join(words[w["start"]:w["start"] + w["n"] + window - 1]).decode()} for w in want])
        return (out,)

    piece = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("start", T.IntegerType()),
                          T.StructField("words", T.StringType())])
    per_doc = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "start", "n")).alias("want"))
    found = map_texts(docs.join(per_doc, KEY), cut, T.StructType([T.StructField("found", T.ArrayType(piece))]), KEY, SLICE_BYTES, "_gc_text", ("want",))
    return found.select(*KEY, F.explode("found").alias("p")).select(*KEY, "p.*")


def repeated_starts(texts: list[list[bytes]], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each text of a shard, the window starts whose words occur at least twice in the shard."""
    ids: dict[bytes, int] = {}
    seq = np.fromiter((i for ws in texts for i in (*(ids.setdefault(w, len(ids) + 1) for w in ws), 0)), np.int64)
    sizes = np.array([len(ws) for ws in texts])
    index = FMIndex(seq, len(ids) + 1, sample=0, weights=np.repeat(weights, sizes + 1))
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = np.where(weights > 1, 0, np.maximum(sizes - window + 1, 0))       # a text met twice has all its windows twice
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = index.matching(seq, begin[owner] + start, window) == window
    found = np.split(start[hit], np.searchsorted(owner[hit], np.arange(1, len(texts))))
    return [np.arange(size - window + 1) if w > 1 else f for f, w, size in zip(found, weights, sizes)]


def _shards(texts: DataFrame, window: int) -> DataFrame:
    """``(anchor, piece, starts)`` for ``texts (anchor, piece, words, weight)`` that hold repeated windows."""
    total = texts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_shards = max(partitions(texts.sparkSession), total // SHARD_BYTES + 1)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts([w.encode().split(b" ") for w in pdf["words"]], pdf["weight"].to_numpy(np.int64), window)
        pdf = pdf[["anchor", "piece"]].assign(starts=[f.astype(np.int32) for f in found])
        return pdf[[len(f) > 0 for f in found]]

    return texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards))) \
        .groupBy("shard").applyInPandas(search, "anchor bigint, piece bigint, starts array<int>")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(*KEY, spans)`` for ``docs (*KEY, _text)``: ``(start, starts)`` of repeated windows."""
    anchored = _anchored(docs, window)
    # A table of its own: few anchors are broadcast, and else both sides of the join are plain
    # shuffles, whose hot parts Spark splits.
    often = settle(anchored.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"))
    wanted = anchored.join(F.broadcast(often) if fits_broadcast(often) else often, "anchor", "left_semi")
    cut = settle(_cut_out(docs, wanted, window)
                 .withColumn("piece", F.xxhash64("words")))
    distinct = settle(cut.groupBy("anchor", "piece", "words").agg(F.count("*").alias("weight")))
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_PIECES).select("anchor")
    hot = settle(hot)
    if hot.isEmpty():
        found = _shards(distinct, window)
    else:
        plain = distinct.join(hot, "anchor", "left_anti")
        words = F.split("words", " ")
        singles = distinct.join(hot, "anchor", "left_semi") \
            .select("anchor", "piece", "weight", words.alias("w"), F.explode(F.sequence(F.lit(0), F.size(words) - window)).alias("at")) \
            .select("anchor", "piece", "weight", "at", F.array_join(F.slice("w", F.col("at") + 1, window), " ").alias("words"))
        singles = settle(singles.withColumn("key", F.xxhash64("words")))
        summed = singles.groupBy("key", "words").agg(F.sum("weight").alias("weight")) \
            .select(F.col("key").alias("anchor"), F.col("key").alias("piece"), "words", "weight")
        again = _shards(summed, window).select(F.col("anchor").alias("key"))
        found = _shards(plain, window).unionByName(
            singles.join(again, "key").groupBy("anchor", "piece").agg(F.collect_list(F.col("at").cast("int")).alias("starts")))
    return cut.select(*KEY, "anchor", "piece", "start").join(settle(found), ["anchor", "piece"]) \
        .groupBy(*KEY).agg(F.collect_list(F.struct("start", "starts")).alias("_gc_spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``text`` less the words of repeated windows (single spaces between words),
    and ``n_words`` (before), ``n_removed``."""
    names = [n for n in (docs.columns if keep is None else keep) if n.lower() not in ("n_words", "n_removed", text.lower())]
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(F.col(text).alias("_gc_text"), box(docs, names), F.xxhash64(id_).alias(KEY[0]),
                        F.xxhash64(F.coalesce(text, F.lit(""))).alias(KEY[1]))
    read = keyed.join(repeated_spans(keyed.select(*KEY, "_gc_text"), window), KEY, "left").drop(*KEY)

    def rewrite(batch):
        out = []
        for t, found in zip(utf8(batch, "_gc_text"), batch.column("_gc_spans").to_pylist()):
            words = t.split()
            n = len(words)
            if found:
                gone = np.zeros(n + 1, np.int64)
                at = np.unique(np.concatenate([np.add(f["start"], f["starts"]) for f in found]))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
            out.append((n, n - len(words), b" ".join(words).decode()))
        return list(zip(*out))

    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType())])
    done = map_texts(read, rewrite, fields, [BOX], SLICE_BYTES, "_gc_text", ("_gc_spans",))
    return done.select(*unbox(names), F.col("kept").alias(text), "n_words", "n_removed")
