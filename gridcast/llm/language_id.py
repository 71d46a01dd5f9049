"""Language ID by compression: the language whose dictionary packs a text smallest.

Each language's dictionary is raw text of a bounded sample of its labelled documents
(``SAMPLE_DOCS`` documents, the first ``SAMPLE_CHARS`` of each, chosen by hash). A text's letters,
lower-cased, are compressed whole, in pieces of ``PIECE`` bytes, once per language; pieces keep
the dictionary in play over a long text. The score is the saving of the best over the second
best size. Where it is below ``MIN_MARGIN`` a stronger level has the last word, and if that is as
narrow the document is rejected.

Defined results: ``lang_pred`` is ``und`` (score 0, rejected) where the text is NULL, empty or has no
letter, or where no language was learned. Very long texts are compressed whole, piece by piece.
Of languages of equal size the first in the order of their names is taken, with score 0, and
rejected. Rows with a NULL language or ``doc_id`` teach nothing; repeated rows are predicted alike.
An empty table gives no rows. Input columns named like a result give way to it, in any case of
letters.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.functions.scale_out import lookup_join
from gridcast.llm.common import map_texts

SAMPLE_DOCS, SAMPLE_CHARS = 64, 3000
PIECE, LEVELS = 2048, (9, 12)
MIN_MARGIN = 0.002
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("rejected", T.BooleanType())])


class Languages:
    """One dictionary per language; compressors are made where they are used."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples = dict(sorted(samples.items()))
        self._packers = None

    def __getstate__(self):
        return {"samples": self.samples, "_packers": None}

    def _made(self) -> list[list]:
        if self._packers is None:
            self._packers = [[_packer(raw, level) for raw in self.samples.values()] for level in LEVELS]
        return self._packers

    def classify(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        if not self.samples or not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, True
        names = list(self.samples)
        data = letters(text)
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        for packers in self._made():
            ranked = sorted((sum(len(p.compress(x)) for x in pieces), name) for p, name in zip(packers, names))
            score = 1 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0
            if score >= min_margin:
                return ranked[0][1], score, False
        return ranked[0][1], score, True


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def _packer(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Languages:
    """From ``(doc_id, text, lang)``."""
    told = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    place = F.xxhash64("doc_id")
    chosen = told.select("lang", "doc_id", F.pmod(place, F.lit(sample_docs)).alias("part"), place.alias("place")) \
        .groupBy("lang", "part").agg(F.min_by("doc_id", "place").alias("doc_id")).select("doc_id").distinct()
    texts = lookup_join(told.select("doc_id", "lang", "text"), chosen, "doc_id", salt_by="text") \
        .select("lang", F.xxhash64("doc_id").alias("place"), F.substring("text", 1, sample_chars).alias("text"))
    samples: dict[str, list] = {}
    for r in texts.distinct().collect():               # at most sample_docs texts a language
        samples.setdefault(r["lang"], []).append((r["place"], r["text"]))
    return Languages({k: b" ".join(letters(t) for _, t in sorted(v)) for k, v in samples.items()})


def identify(docs: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None,
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        return list(zip(*(shared.value.classify(t, min_margin) for t in batch.column(text).to_pylist())))

    return map_texts(docs, run, FIELDS, keep, text=text)


def training_fold(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out())


def held_out():
    """A third of the documents, by the checksum of their id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
