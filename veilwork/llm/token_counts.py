"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone by the merges; those that end
as one token are proven whole. A pre-token among them counts one without any
merging; only the rest goes through the merge rounds of bpe.py.

Edge cases: a null text counts as empty (no bytes, no tokens); repeated rows
give equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.bpe import KEPT_WORDS, Vocabulary, portions, vocabulary
from veilwork.llm.common import texts_of


def whole_tokens(vocab: Vocabulary) -> set[str]:
    """Vocabulary strings that are text and encode alone as one token: their own."""
    ids = [i for i, b in enumerate(vocab.bytes_of) if b and i not in vocab.special.values()]
    flat, begins = vocab.merge([vocab.bytes_of[i] for i in ids])
    alone = np.flatnonzero(np.diff(begins) == 1)
    proven = set()
    for k in alone.tolist():
        if flat[begins[k]] == ids[k]:
            try:
                proven.add(vocab.bytes_of[ids[k]].decode())
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                continue
    return proven


@lru_cache(maxsize=4)
def proven_whole(path: str) -> frozenset[str]:
    return frozenset(whole_tokens(vocabulary(path)))


class Counter:
    """Counts tokens of texts; counts of merged words are kept up to a bound."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[str]):
        self.vocab = vocab
        self.whole = dict.fromkeys(whole, 1) | dict.fromkeys(vocab.special, 1)
        self.counts = dict(self.whole)

    def learn(self, words: set[str]) -> None:
        if len(self.counts) > KEPT_WORDS + len(self.whole):
            self.counts = dict(self.whole)
        rest = list(words - self.counts.keys())
        _, begins = self.vocab.merge([w.encode() for w in rest])
        self.counts.update(zip(rest, np.diff(begins).tolist()))

    def count(self, texts: list[str]) -> Iterator[int]:
        for some in portions(texts):
            cut = [self.vocab.pieces(t) for t in some]
            self.learn(set(chain.from_iterable(cut)))
            for words in cut:
                yield sum(map(self.counts.__getitem__, words))


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """The counter of a worker process, which several tasks use one after the other."""
    return Counter(vocabulary(path), proven_whole(path))


def count_tokens(df: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of df (doc_id, text)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            n = list(counter(path).count(texts))
            columns = [
                batch.column("doc_id"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
