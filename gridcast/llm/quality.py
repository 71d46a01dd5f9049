"""Quality rules over lines labelled by a linear-chain conditional random field.

Viterbi decoding marks each line of a text as content or boilerplate from coarse features of
the line and the label of its neighbour. A document is kept if it passes the base rules and at
least ``MIN_CONTENT`` of its words' characters stand in content lines.

The field is fitted here, by maximum likelihood (forward-backward in numpy, fixed steps), on a
bounded sample: at most ``SAMPLE_DOCS`` labelled documents chosen by hash, cut into chains of
``CHAIN`` lines, at most ``SAMPLE_CHAINS`` of these. Documents are labelled, lines are not: a
line's label is that of its document unless its features speak against it (``line_targets``), so
good documents hold boilerplate and bad ones content.

Defined results: a NULL or empty text has no words and fails the base rules; very long texts are
read whole. Without labels, or with one kind only, every line is content; of labellings that score
alike content wins, and a share equal to ``MIN_CONTENT`` is kept. Repeated rows are judged alike;
an empty table gives no rows. Input columns named like a result give way to it, in any case of
letters.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridcast.functions.scale_out import lookup_join
from gridcast.llm.common import joined, map_texts

MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20       # of 100 words
MIN_CONTENT = 0.5
SAMPLE_DOCS, SAMPLE_CHAINS, CHAIN = 2000, 4000, 64
PULL = 2.0                                        # of a document's label on its lines, in log odds
STEPS, RATE, RIDGE, ENOUGH = 150, 0.5, 1e-3, 1e-3
SYMBOLS = b"#*$%&|<>"
BINS = (5, 4, 3, 2, 2, 3)                         # of line_code
N_CODES = int(np.prod(BINS))
FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                      + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()),
                         T.StructField("kept", T.BooleanType())])


def line_code(line: bytes, words: list[bytes], again: bool) -> int:
    """Coarse features of a line with words, as one number below ``N_CODES``."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    upper = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(line) - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    odd = line.count(b"!!") + line.count(b"???")
    digits = len(line) - len(line.translate(None, b"0123456789"))
    bins = (min(4, n.bit_length() - 1),
            0 if not symbols else 1 if 10 * symbols < n else 2 if symbols < n else 3,
            0 if 10 * upper < 3 * letters else 1 if 10 * upper < 8 * letters else 2,
            int(again), int(4 * odd > n),
            0 if 20 * digits < len(line) else 1 if 4 * digits < len(line) else 2)
    code = 0
    for b, size in zip(bins, BINS):
        code = code * size + b
    return code


def line_codes(text: bytes) -> tuple[list[int], list[int]]:
    """Codes and word characters of the lines with a word."""
    codes, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            codes.append(line_code(line, words, line in seen))
            sizes.append(sum(map(len, words)))
            seen.add(line)
    return codes, sizes


def _features() -> np.ndarray:
    """Codes by indicator features: one per bin of each feature, and a constant."""
    left = np.arange(N_CODES)
    columns = [np.ones((N_CODES, 1))]
    for size in reversed(BINS):
        columns.append(np.eye(size)[left % size])
        left = left // size
    return np.concatenate(columns, axis=1)


class LineField:
    """Scores of content over boilerplate per line code, and of one label after another."""

    def __init__(self, code_scores: np.ndarray, moves: np.ndarray):
        self.scores, self.moves = code_scores.tolist(), moves.tolist()

    def content(self, codes: list[int]) -> list[bool]:
        """Viterbi decoding; a tie is content."""
        (m00, m01), (m10, m11) = self.moves
        a, b, back = 0.0, 0.0, []              # best ends in boilerplate, in content
        for i, c in enumerate(codes):
            if i:
                from_b0, from_b1 = b + m10 > a + m00, b + m11 >= a + m01
                back.append((from_b0, from_b1))
                a, b = (b + m10 if from_b0 else a + m00), (b + m11 if from_b1 else a + m01)
            b += self.scores[c]
        label = b >= a
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1] if codes else []


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def line_targets(chains: list[tuple[list[int], bool]]) -> list[list[bool]]:
    """Content or boilerplate for every line of some documents called good or bad.

    How much more often a line's features occur in good documents than in bad ones, feature by
    feature, is weighed against its own document's label, which counts ``PULL``: telling lines go
    against the label of their document, others follow it.
    """
    features = _features()
    count = np.ones((2, features.shape[1]))
    lines = np.full(2, float(max(BINS)))
    for codes, good in chains:
        count[int(good)] += features[codes].sum(axis=0)
        lines[int(good)] += len(codes)
    odds = features[:, 1:] @ np.log((count[1] / lines[1]) / (count[0] / lines[0]))[1:]
    return [(odds[codes] + (PULL if good else -PULL) >= 0).tolist() for codes, good in chains]


def _padded(chains: list[tuple[tuple[int, ...], tuple[bool, ...]]], counts: list[int]):
    """Codes, labels and which places are real, and how often each chain counts."""
    width = max(len(c) for c, _ in chains)
    codes, labels, real = (np.zeros((len(chains), width), t) for t in (np.int64, np.int64, bool))
    for i, (c, y) in enumerate(chains):
        codes[i, :len(c)], labels[i, :len(c)], real[i, :len(c)] = c, y, True
    return codes, labels, real, np.array(counts, float)


def fit_field(chains: list[tuple[list[int], list[bool]]]) -> LineField:
    """Regularised maximum likelihood of the lines' labels, by gradient steps until they are small.
    Chains that are alike are counted once, and chains of like length worked on together."""
    features = _features()
    alike = Counter((tuple(c), tuple(y)) for c, y in chains if c)
    if len({label for _, y in alike for label in y}) < 2:
        return LineField(np.ones(N_CODES), np.zeros((2, 2)))
    lots: dict[int, list] = {}
    for chain, n in alike.items():
        lots.setdefault(len(chain[0]).bit_length(), []).append((chain, n))
    lots_ = [_padded(*zip(*lot)) for lot in lots.values()]
    seen, told, total = np.zeros(N_CODES), np.zeros((2, 2)), 0.0
    for codes, labels, real, n in lots_:
        total += (real * n[:, None]).sum()
        np.add.at(seen, codes, labels * real * n[:, None])
        np.add.at(told, (labels[:, :-1], labels[:, 1:]), real[:, 1:] * n[:, None])
    weights, moves = np.zeros(features.shape[1]), np.zeros((2, 2))
    for _ in range(STEPS):
        expected, pairs, scores = np.zeros(N_CODES), np.zeros((2, 2)), features @ weights
        for lot in lots_:
            _expect(lot, scores, moves, expected, pairs)
        up, over = (seen - expected) @ features / total - RIDGE * weights, (told - pairs) / total - RIDGE * moves
        weights += RATE * up
        moves += RATE * over
        if max(np.abs(up).max(), np.abs(over).max()) < ENOUGH:
            break
    return LineField(features @ weights, moves)


def _expect(lot, scores: np.ndarray, moves: np.ndarray, expected: np.ndarray, pairs: np.ndarray) -> None:
    """Add the expected content lines per code, and label pairs, of some chains (forward-backward)."""
    codes, _, real, n = lot
    width = codes.shape[1]
    local = scores[codes] * real
    ahead, behind = np.zeros((width, len(codes), 2)), np.zeros((width, len(codes), 2))
    ahead[0, :, 1] = local[:, 0]
    for t in range(1, width):
        step = _log_sum(ahead[t - 1][:, :, None] + moves[None], 1)
        step[:, 1] += local[:, t]
        ahead[t] = np.where(real[:, t, None], step, ahead[t - 1])
    for t in range(width - 2, -1, -1):
        later = behind[t + 1].copy()
        later[:, 1] += local[:, t + 1]
        step = _log_sum(moves[None] + later[:, None, :], 2)
        behind[t] = np.where(real[:, t + 1, None], step, behind[t + 1])
    norm = _log_sum(ahead[-1], 1)
    np.add.at(expected, codes.T, np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm) * real.T * n)
    for t in range(1, width):
        later = behind[t].copy()
        later[:, 1] += local[:, t]
        joint = np.exp(ahead[t - 1][:, :, None] + moves[None] + later[:, None, :] - norm[:, None, None])
        pairs += (joint * (real[:, t] * n)[:, None, None]).sum(axis=0)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> LineField:
    """From documents whose ``labels (doc_id, quality)`` are known."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    told = lookup_join(docs.select("doc_id", text), chosen, "doc_id", salt_by=text)
    field = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType()))])
    coded = map_texts(told, lambda b: ([line_codes((x or "").encode())[0] for x in b.column(text).to_pylist()],),
                      field, ["doc_id", "quality"], text=text)
    chains = coded.filter("size(codes) > 0").select(
        "doc_id", "quality", "codes", F.explode(F.sequence(F.lit(1), F.size("codes"), F.lit(CHAIN))).alias("at")) \
        .select("doc_id", "quality", "at", F.slice("codes", F.col("at"), CHAIN).alias("codes")) \
        .orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "codes").limit(SAMPLE_CHAINS).collect()
    told = [(r["codes"], r["quality"] > 0) for r in chains]
    return fit_field(list(zip([c for c, _ in told], line_targets(told))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers to well-spread 64-bit ones."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Per text, the words in windows found twice or more in that text (64-bit window hashes)."""
    flat, ends = joined(words)
    n = len(flat) - window + 1
    if n < 1:
        return np.zeros(len(words), np.int64)
    ids: dict[bytes, int] = {}
    spread = _mixed(np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.uint64, len(flat)))
    doc = np.repeat(np.arange(len(words)), np.diff(ends))
    window_hash = _mixed(doc[:n].astype(np.uint64))
    for k in range(window):
        window_hash = _mixed(window_hash + spread[k:n + k])
    inside = np.flatnonzero(doc[:n] == doc[window - 1:])
    order = inside[np.argsort(window_hash[inside])]
    same = window_hash[order[1:]] == window_hash[order[:-1]]
    twice = np.zeros(len(flat) + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(twice)[:-1] > 0)])
    return covered[ends[1:]] - covered[ends[:-1]]


def judge(docs: DataFrame, field: LineField, text: str = "text", keep: list[str] | None = None,
          min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``content_share`` and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch):
        known, out = shared.value, []
        texts = [t or "" for t in batch.column(text).to_pylist()]
        raw = [t.encode() for t in texts]
        words = [t.split() for t in raw]
        for t, b, ws, repeated in zip(texts, raw, words, repeated_words(words).tolist()):
            codes, sizes = line_codes(b)
            content = sum(s for s, good in zip(sizes, known.content(codes)) if good)
            share = content / sum(sizes) if sizes else 0.0
            failed = len(ws) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(ws)
            spaces = len(b) - len(b.translate(None, b" \t\n\x0b\x0c\r"))
            lines = [x for x in b.split(b"\n") if x.split()]
            out.append((len(ws), len(t) - spaces, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                        repeated, failed, share, not failed and share >= min_content))
        return list(zip(*out))

    return map_texts(docs, run, FIELDS, keep, size=4 << 20, text=text)
