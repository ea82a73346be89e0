"""Quality rules: a linear-chain CRF labels the lines of a text as content or boilerplate.

Each line with a word has yes-or-no features. The emission weights start from
PRIOR and are fitted on a bounded sample of labelled documents; without labels
PRIOR holds. A document's label is not a label of its lines: those stay hidden,
and the label only bounds the share of characters that content lines may be
expected to have, at least GOOD_SHARE in a good document and at most BAD_SHARE in
a bad one (posterior regularisation: forward-backward in numpy, with a
multiplier for each document that breaks its bound). Moves between states are
MOVES, as no document's label tells of them. Viterbi decoding finds the best
labels of a whole text, and the share of characters in content lines decides
retention.

Edge cases: a null text counts as empty; it has no words, so it fails the base
rules; repeated rows give equal rows; an empty table gives an empty table; other
columns are not read. Rows of labels with nulls, and documents with both
qualities, are no training rows; of rows that share a doc_id one is taken, that
whose lines come first in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.bpe import portions
from veilwork.llm.common import texts_of, thin, unwrapped, wrapped

#: Fixed values of the base rules.
SYMBOLS, BLANKS = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

FEATURES = (
    "always", "few_words", "many_words", "sentence_end", "capital_start", "symbols", "bars", "digits",
    "shouting", "marks_in_row", "same_words", "seen_before", "link", "notice",
)
#: Weights of content against boilerplate before any training, and log-odds of moves (from, to: 00, 01, 10, 11; 1 is content).
PRIOR = (1.5, -0.2, 0.5, 0.5, 0.3, -2.0, -2.0, -1.0, -2.0, -2.0, -3.0, -0.5, -0.5, -1.0)
MOVES = (1.0, 0.0, 0.0, 1.0)
NOTICE = re.compile(r"(?i)cookie|copyright|all rights reserved|subscribe|click here|terms of use|privacy policy|licen[sc]e")
#: Documents of each label that training takes, lines of each (a run from a hashed place), steps, and strength of the prior.
SAMPLE, SAMPLE_LINES, STEPS, PRIOR_STRENGTH = 400, 64, 150, 2.0
#: Bounds of the expected content share of good and bad documents, and how fast multipliers follow what breaks them.
GOOD_SHARE, BAD_SHARE, PACE = 0.8, 0.2, 2.0
#: A text is kept if at least so much of its characters is content.
CONTENT_SHARE = 0.5


@dataclass(frozen=True)
class Chain:
    """Weights of content against boilerplate, and log-odds of moves between them."""

    weights: tuple[float, ...] = PRIOR
    moves: tuple[float, float, float, float] = MOVES


def line_features(line: str, words: list[str], seen: bool) -> int:
    """The features of a line that has words, as bits in the order of FEATURES."""
    n, chars = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS))
    letters = line.strip(BLANKS)
    f = 1
    f |= (n < 3) << 1
    f |= (n >= 8) << 2
    f |= (letters[-1] in ".?!:;\"')»”") << 3
    f |= letters[0].isupper() << 4
    f |= (12 * symbols > chars) << 5
    f |= (line.count("|") > 2) << 6
    f |= (chars > 8 and 4 * sum(map(line.count, "0123456789")) > chars) << 7
    f |= (n > 2 and line.isupper()) << 8
    f |= ("!!" in line) << 9
    f |= (n >= 6 and 2 * len(set(words)) < n) << 10
    f |= seen << 11
    f |= ("http" in line or "www." in line) << 12
    f |= (NOTICE.search(line) is not None) << 13
    return f


def words_of(text: str) -> list[bytes]:
    """ASCII white space parts words, nothing else does."""
    return text.encode().split()


def featured_lines(text: str) -> tuple[list[int], list[int], int]:
    """Features and lengths of the lines with a word, and how many of them equal an earlier line."""
    features, sizes, seen, repeated = [], [], set(), 0
    for line in text.split("\n"):
        words = line.encode().split()
        if not words:
            continue
        again = line in seen
        repeated += again
        seen.add(line)
        features.append(line_features(line, words, again))
        sizes.append(len(line))
    return features, sizes, repeated


class Decoder:
    """Viterbi decoding; scores of feature sets are looked up."""

    def __init__(self, fitted: Chain):
        self.moves = fitted.moves
        bits = np.arange(1 << len(FEATURES))
        self.scores = sum(((bits >> k) & 1) * w for k, w in enumerate(fitted.weights)).tolist()

    def content(self, features: list[int]) -> list[bool]:
        """Whether each line is content in the best labelling of all."""
        if not features:
            return []
        stay0, to1, to0, stay1 = self.moves
        a, b, back = 0.0, self.scores[features[0]], []
        for f in features[1:]:
            from1_a, from0_b = b + to0 > a + stay0, a + to1 > b + stay1
            back.append((from1_a, not from0_b))
            a, b = (b + to0 if from1_a else a + stay0), (a + to1 if from0_b else b + stay1) + self.scores[f]
        labels = [b > a]
        for from1_a, from1_b in reversed(back):
            labels.append(from1_b if labels[-1] else from1_a)
        return labels[::-1]


def marginals(emit: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of each line (documents by lines) the probability that it is content, from log-odds of its features and MOVES."""
    stay0, to1, to0, stay1 = MOVES
    ahead, behind = emit.copy(), np.zeros_like(emit)  # log-odds of content, with what stands before or behind
    for t in range(1, emit.shape[1]):
        x = ahead[:, t - 1]
        ahead[:, t] += np.logaddexp(x + stay1, to1) - np.logaddexp(x + to0, stay0)
    for t in range(emit.shape[1] - 2, -1, -1):
        x = emit[:, t + 1] + behind[:, t + 1]
        behind[:, t] = np.where(there[:, t + 1], np.logaddexp(x + stay1, to0) - np.logaddexp(x + to1, stay0), 0)
    return np.where(there, 1 / (1 + np.exp(-(ahead + behind))), 0)


def fit(lines: list[list[int]], sizes: list[list[int]], labels: list[int]) -> Chain:
    """The chain for documents' lines (features and characters) under the bounds that their labels set."""
    if not lines:
        return Chain()
    D, T, K = len(lines), max(map(len, lines)), len(FEATURES)
    bits, there, chars = np.zeros((D, T), np.int64), np.zeros((D, T), bool), np.zeros((D, T))
    for d, (row, own) in enumerate(zip(lines, sizes)):
        bits[d, : len(row)], chars[d, : len(row)], there[d, : len(row)] = row, own, True
    x = ((bits[:, :, None] >> np.arange(K)) & 1).astype(float) * there[:, :, None]
    chars /= chars.sum(1, keepdims=True)
    good = np.array(labels) == 1
    sign, bound = np.where(good, 1.0, -1.0), np.where(good, GOOD_SHARE, BAD_SHARE)
    per_line = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) / there.sum(1)
    weights, multiplier = np.array(PRIOR), np.zeros(D)
    first, second = np.zeros(K), np.zeros(K)
    tilt = chars * there.sum(1, keepdims=True)
    for step in range(1, STEPS + 1):
        emit = x @ weights
        free = marginals(emit, there)
        bounded = marginals(emit + (sign * multiplier)[:, None] * tilt, there)
        multiplier = np.maximum(0, multiplier + PACE * sign * (bound - (bounded * chars).sum(1)))
        g = np.einsum("dt,dtk,d->k", bounded - free, x, per_line) - PRIOR_STRENGTH / D * (weights - PRIOR)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        weights = weights + 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(tuple(np.round(weights, 6).tolist()))


def train(df: DataFrame, labels: DataFrame) -> Chain:
    """Fit on a bounded sample of labelled rows: SAMPLE documents of each quality, SAMPLE_LINES lines of each."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    rows = rows.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    order = F.xxhash64("doc_id")
    taken = [r for q in (0, 1) for r in rows.where(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE).collect()]
    quality = {r["doc_id"]: r["quality"] for r in taken}
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("lines", lists), ("sizes", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            lines, sizes = [], []
            for doc_id, text in zip(ids.to_pylist(), texts_of(batch)):
                features, chars, _ = featured_lines(text)
                begin = doc_id * 2654435761 % max(1, len(features) - SAMPLE_LINES + 1)
                lines.append(features[begin : begin + SAMPLE_LINES])
                sizes.append(chars[begin : begin + SAMPLE_LINES])
            yield pa.RecordBatch.from_arrays([ids, pa.array(lines, lists), pa.array(sizes, lists)], schema=schema)

    if not quality:
        return Chain()
    some = df.where(F.col("doc_id").isin(list(quality))).select("doc_id", "text")
    cut = some.mapInArrow(run, "doc_id long, lines array<int>, sizes array<int>").where("size(lines) > 0")
    one = cut.groupBy("doc_id").agg(F.min(F.struct("lines", "sizes")).alias("cut"))
    found = sorted((r["doc_id"], r["cut"]["lines"], r["cut"]["sizes"]) for r in one.collect())
    return fit([f[1] for f in found], [f[2] for f in found], [quality[f[0]] for f in found])


def repeated_words(docs: list[list[bytes]]) -> list[int]:
    """Of each text the words in windows of WINDOW words that it has twice or more."""
    sizes = np.array([len(w) for w in docs], np.int64)
    fresh = count()
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids[w] if w in ids else ids.setdefault(w, next(fresh)) for w in chain.from_iterable(docs)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(docs)), sizes)
    n = len(flat) - WINDOW + 1
    if n < 2:
        return [0] * len(docs)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    mixed = doc[inside].astype(np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + flat[inside + k].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    inside = inside[np.sort(order[twice])]
    # equal mixes are candidates; equal words decide
    rows = np.stack([doc[inside], *(flat[inside + k] for k in range(WINDOW))], axis=1)
    order = np.lexsort(rows.T[::-1])
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begins = inside[order[twice]]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(docs)).tolist()


@dataclass(frozen=True)
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lines: int
    content_share: float


def verdicts(texts: list[str], decoder: Decoder, least_share: float) -> Iterator[Verdict]:
    for some in portions(texts):
        words = [words_of(t) for t in some]
        for text, own, repeated in zip(some, words, repeated_words(words)):
            n = len(own)
            features, sizes, again = featured_lines(text)
            content = sum(s for s, good in zip(sizes, decoder.content(features)) if good)
            share = content / sum(sizes) if sizes else 0.0
            failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
            chars = len(text) - sum(map(text.count, BLANKS))
            symbols = sum(map(text.count, SYMBOLS))
            yield Verdict(n, chars, symbols, again, repeated, failed, not failed and share >= least_share, len(sizes), share)


RULES = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
 base_failed boolean, kept boolean, n_lines long, content_share double"""


def judge(df: DataFrame, fitted: Chain, least_share: float = CONTENT_SHARE) -> DataFrame:
    """Base counts, line labels summed up, and the verdict on every row of df (doc_id, text)."""
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
    schema = pa.schema(list(zip([c.split()[0] for c in RULES.split(",")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(fitted)
        for batch in batches:
            rows = [astuple(v) for v in verdicts(texts_of(batch), decoder, least_share)]
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kinds[k + 1]) for k in range(9))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, RULES)


def keep(df: DataFrame, fitted: Chain, least_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of df whose text is kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(fitted)
        for batch in thin(batches):
            texts = ["" if t is None else t for t in batch.column("row").field("text").to_pylist()]
            yield batch.filter(pa.array([v.kept for v in verdicts(texts, decoder, least_share)], pa.bool_()))

    rows = wrapped(df)
    return unwrapped(rows.mapInArrow(run, rows.schema), df.columns)
