"""Benchmark decontamination by an FM-index per training shard.

A shard is a slice of documents inside a task. Its words become the ids of the benchmark's
vocabulary; a stretch of words that holds a word unknown to the benchmark cannot be part of an
occurrence, so only stretches long enough for a window are indexed. All windows of the
benchmark are searched backwards in that index, their occurrences located by the sampled
suffix positions, and overlapping ones merged into removal spans.

The benchmark is dealt in blocks of bounded size; one settled pass over the documents per block.

Defined results: a NULL or empty text has no words; very long texts are searched whole; an item
with a NULL id marks spans but is not listed, and items are listed in code-point order. Repeated
rows are treated like any other, items of one id as one. An empty benchmark hits nothing, an
empty table gives no rows. Input columns named like a result give way to it, in any case of
letters; :func:`clean` keeps them.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.functions.scale_out import settle
from gridcast.llm.common import map_texts, utf8
from gridcast.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 2 << 20      # benchmark text of one block, held by every task in some 70 times the space
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("spans", T.ArrayType(SPAN)),
                       T.StructField("items", T.ArrayType(T.StringType()))])
_APART = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, letters and anything beyond ASCII."""
    return text.lower().translate(_APART).split()


class Phrases:
    """The windows of some benchmark items, over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in split_words(text)]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                owners.setdefault(tuple(seq[i:i + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), window), np.int64)
        for row, w in zip(self.patterns, owners):
            row[:len(w)] = w
        self.owners = [[x for x in s if x is not None] for s in owners.values()]
        self.shortest = int(self.lengths.min(initial=window))

    def find(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``seq`` (0 where a word is unknown or a text ends) and window numbers."""
        gaps = np.flatnonzero(seq == 0)
        runs = np.diff(gaps, prepend=-1)
        keep = np.zeros(len(seq) + 1, np.int64)
        long = runs > self.shortest
        np.add.at(keep, gaps[long] - runs[long] + 1, 1)
        np.add.at(keep, gaps[long] + 1, -1)
        at = np.flatnonzero(np.cumsum(keep)[:-1])
        if not len(at) or not len(self.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(seq[at], len(self.ids) + 1)
        lo, hi = index.search(self.patterns, self.lengths)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        return at[index.locate(rows)], which


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, block: list[tuple[str | None, bytes]], window: int,
          keep: list[str] | None, text: str, more: bool) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

    def find(batch):
        known = phrases.value
        words = [split_words(t) for t in utf8(batch, text)]
        flat: list[bytes] = []
        for ws in words:
            flat += ws
            flat.append(b"")
        starts = np.cumsum([0, *(len(ws) + 1 for ws in words)], dtype=np.int64)
        at, which = known.find(np.fromiter(map(known.ids.get, flat, repeat(0)), np.int64, len(flat)))
        spans: list[list] = [[] for _ in words]
        items: list[set] = [set() for _ in words]
        if more:
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, a, w in zip(doc.tolist(), (at - starts[doc]).tolist(), which.tolist()):
            spans[d].append((a, a + int(known.lengths[w])))
            items[d].update(known.owners[w])
        spans = [_merge(x) for x in spans]
        return ([len(ws) for ws in words], [sum(b - a for a, b in x) for x in spans],
                [[{"start": a, "end": b} for a, b in x] for x in spans], [sorted(x) for x in items])

    return map_texts(docs, find, FIELDS, keep, text=text, uses=("spans", "items") if more else ())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  keep: list[str] | None = None, text: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document with ``n_words``, ``n_hit``, merged word ``spans`` and the ``items`` found.

    ``keep``: the columns of ``docs`` to carry on, default all. Items shorter than ``window``
    words are one window.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("t")).filter("t is not null")
    n_blocks = (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes + 1
    out = docs
    for i in range(n_blocks):
        mine = items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)) == i)
        block = [(r["id"], r["t"].encode()) for r in mine.toLocalIterator()]
        last = i == n_blocks - 1
        names = keep if last or keep is None else [*keep, text]
        out = _pass(out, block, window, names, text, i > 0)
        out = out if last else settle(out)             # one block in a task's memory at a time
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no benchmark window touches, with their own columns."""
    if not {c.lower() for c in docs.columns} & set(FIELDS.names):
        return contamination(docs, benchmark, **how).filter("n_hit = 0").select(*docs.columns)
    text = how.get("text", "text")                     # columns named like ours come through inside a struct
    whole = docs.select(F.struct("*").alias("_gc_row"), F.col(text))
    return contamination(whole, benchmark, keep=["_gc_row"], **how).filter("n_hit = 0").select("_gc_row.*")
