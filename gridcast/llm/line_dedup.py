"""Line dedup by two Bloom filters, for hashes seen once and seen twice.

First pass: the hashes of each document's line keys, 8 bytes each, are dealt by their leading
bits to segments. A segment's pair of filters takes them in: a hash already in the first
filter goes to the second. Pairs made apart merge, as a bit set in both first filters was seen
twice. Second pass: only lines in the second filter leave their task, for the exact count of
documents and the choice of the document that keeps the line.

The second filter is broadcast and never larger than ``MAX_BITS``. Beyond about 16 bits a line
it lets more lines through; the result stays exact.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Documents
are told apart by ``doc_id``: rows that share it count once and are treated alike, rows
without it count as no document and stay whole.

Defined results: a NULL or empty text is one empty line; very long texts are read whole; of
documents that share a line the one with the largest ``doc_id`` keeps it, in all of its places and
rows. An empty table gives no rows. The user's columns travel in one struct, so any names are
fine; one named like a result gives way to it, in any case of letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.functions.scale_out import lookup_join, settle
from gridcast.llm.common import BOX, box, map_texts, partitions, slices, unbox, utf8

MIN_CHARS, MIN_DOCS = 20, 3
SEGMENT_BITS = 8                      # so many leading bits of a hash name its segment
MAX_BITS = 1 << 28                    # of the broadcast filter: 32 MB
BITS_A_LINE = 16
FIELDS = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                       T.StructField("text", T.StringType())])


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip().lower() for line in text.split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def repeatable(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in set(line_keys(text)) if _long_enough(k, min_chars)}


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a segment of ``size`` bits."""
    inner = hashes & np.uint64((1 << (64 - SEGMENT_BITS)) - 1)
    return (inner % np.uint64(size)).astype(np.int64), ((inner >> np.uint64(28)) % np.uint64(size)).astype(np.int64)


class FilterPair:
    """Once-seen and twice-seen Bloom filters of one segment."""

    def __init__(self, size: int):
        self.size, self.once, self.twice = size, np.zeros(size, bool), np.zeros(size, bool)

    def add(self, hashes: np.ndarray) -> None:
        hashes, n = np.unique(hashes, return_counts=True)
        a, b = _bits(hashes, self.size)
        again = (self.once[a] & self.once[b]) | (n > 1)
        self.once[a] = self.once[b] = True
        self.twice[a[again]] = self.twice[b[again]] = True

    def packed(self) -> tuple[bytes, bytes]:
        return np.packbits(self.once).tobytes(), np.packbits(self.twice).tobytes()


def _line_hashes(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``(segment, hashes)``: packed 64-bit hashes, each document's keys once."""
    def run(batches):
        for batch in slices(batches, text, 8 << 20):
            found = [xxhash.xxh3_64_intdigest(k) for t in utf8(batch, text) for k in repeatable(t, min_chars)]
            hashes, n = np.unique(np.array(found, np.uint64), return_counts=True)
            hashes = np.sort(np.concatenate([hashes, hashes[n > 1]]))    # seen twice is enough to know
            segment = (hashes >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)
            names, first = np.unique(segment, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([x.tobytes() for x in np.split(hashes, first[1:])] if len(names) else [], pa.binary())],
                ["segment", "hashes"])

    return docs.select(text).mapInArrow(run, "segment bigint, hashes binary")


def _merge_pairs(key, pdf):
    once = np.zeros(len(pdf["once"].iloc[0]), np.uint8)
    twice = once.copy()
    for o, t in zip(pdf["once"], pdf["twice"]):
        o = np.frombuffer(o, np.uint8)
        twice |= np.frombuffer(t, np.uint8) | (once & o)
        once |= o
    pdf = pdf.iloc[:1].copy()
    pdf["twice"] = [twice.tobytes()]
    return pdf[["segment", "twice"]]


def twice_filter(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS,
                 max_bits: int = MAX_BITS) -> np.ndarray:
    """The packed twice-seen filter, one row per segment."""
    spark = docs.sparkSession
    hashes = settle(_line_hashes(docs, text, min_chars))
    n, parts = hashes.agg(F.sum(F.octet_length("hashes")) / 8, F.count("*")).first()
    size = int(BITS_A_LINE * (n or 0)) >> SEGMENT_BITS
    size = min(max_bits >> SEGMENT_BITS, 1 << max(10, size.bit_length()))
    salts = max(1, partitions(spark) >> SEGMENT_BITS)

    def build(batches):
        segment, pair = None, None
        for batch in batches:
            for s, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != segment:
                    if pair:
                        yield _row(segment, pair)
                    segment, pair = s, FilterPair(size)
                pair.add(np.frombuffer(h, np.uint64))
        if pair:
            yield _row(segment, pair)

    def _row(segment, pair):
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), *(pa.array([x], pa.binary()) for x in pair.packed())],
                                          ["segment", "once", "twice"])

    dealt = hashes.withColumn("salt", F.pmod(F.xxhash64("hashes"), F.lit(salts))) \
        .repartition(partitions(spark), "segment", "salt").sortWithinPartitions("segment", "salt").drop("salt")
    pairs = dealt.mapInArrow(build, "segment bigint, once binary, twice binary")
    out = np.zeros((1 << SEGMENT_BITS, size // 8), np.uint8)
    for r in pairs.groupBy("segment").applyInPandas(_merge_pairs, "segment bigint, twice binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["twice"], np.uint8)
    return out


def suspected_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, line)``: each document's keys that may stand in another document too."""
    filters = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text, min_chars, max_bits))

    def run(batches):
        known = filters.value
        size = known.shape[1] * 8
        for batch in slices(batches, text, 8 << 20):
            keys = [list(repeatable(t, min_chars)) for t in utf8(batch, text)]
            flat = [k for ks in keys for k in ks]
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in flat], np.uint64)
            segment = (hashes >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)
            seen = np.ones(len(flat), bool)
            for place in _bits(hashes, size):
                seen &= (known[segment, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            hit = np.flatnonzero(seen)
            row = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array([flat[i].decode() for i in hit], pa.string())],
                ["doc_id", "line"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("line", T.StringType())])
    return docs.select("doc_id", text).filter(F.col("doc_id").isNotNull()).mapInArrow(run, schema)


def repeated_lines(suspected: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(line, keeper)``: keys in at least ``min_docs`` documents, and the largest of these."""
    return suspected.distinct().groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")) \
        .filter(F.col("n") >= min_docs).select("line", "keeper")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        text: str = "text", keep: list[str] | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with ``text`` less the repeated lines, and ``n_lines`` (before), ``n_dropped``."""
    suspected = settle(suspected_lines(docs, text, min_chars, max_bits))
    lost = lookup_join(suspected, repeated_lines(suspected, min_docs), "line", salt_by="doc_id").filter("doc_id <> keeper") \
        .groupBy("doc_id").agg(F.collect_set("line").alias("_gridcast_lost"))
    names = [n for n in (docs.columns if keep is None else keep) if n.lower() not in ("n_lines", "n_dropped", text.lower())]
    read = docs.select("doc_id", F.col(text).alias("_gc_text"), box(docs, names)).join(lost, "doc_id", "left").drop("doc_id")

    def rewrite(batch):
        out = []
        for t, lost_ in zip(utf8(batch, "_gc_text"), batch.column("_gridcast_lost").to_pylist()):
            lines = t.split(b"\n")
            kept = lines
            if lost_:
                gone = {x.encode() for x in lost_}
                kept = [x for x in lines if x.strip().lower() not in gone]
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
        return list(zip(*out))

    fields = T.StructType([*FIELDS.fields[:2], T.StructField("kept", T.StringType())])
    done = map_texts(read, rewrite, fields, [BOX], text="_gc_text", uses=("_gridcast_lost",))
    return done.select(*unbox(names), F.col("kept").alias(text), "n_lines", "n_dropped")
