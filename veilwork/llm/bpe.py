"""Byte-level BPE: pre-tokens, merges in batched numpy rounds, decoding.

The symbols of many words lie in one flat array. A round builds the keys of all
adjacent pairs, finds their ranks by binary search over the sorted pair keys,
and merges in each word every occurrence of that word's lowest-ranked pair.
A word leaves the array as soon as none of its pairs can merge.

Edge cases: a null text counts as empty and gives no tokens; repeated rows give
equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilwork.llm.common import texts_of, thin

#: Fixed values of byte-level BPE: how a text is cut before merging, and the bytes that stand for themselves.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PRINTED_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: The same cut in the two dialects; White_Space is spelled out, as \s also takes \x1c-\x1f in one of them.
ANY_TEXT = regex.compile(
    CONTRACTIONS
    + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    + r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ASCII_TEXT = re.compile(
    CONTRACTIONS
    + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    + r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: Distinct words whose results a worker keeps; beyond it the store starts anew, which costs time only.
KEPT_WORDS = 120_000
#: Characters of text whose new words are merged together.
BATCH_CHARS = 500_000


class Vocabulary:
    """A tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        others = (b for b in range(256) if b not in PRINTED_BYTES)
        byte_of = {chr(b): b for b in PRINTED_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first_symbols = np.zeros(256, np.int64)
        for token, i in ids.items():
            if len(token) == 1 and token in byte_of:
                self.first_symbols[byte_of[token]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int64)
        self.pair_merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the place where each word's ids begin (one more at the end)."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        symbols = self.first_symbols[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            at = np.flatnonzero(owner[1:] == owner[:-1])
            keys = symbols[at] * self.size + symbols[at + 1]
            found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[found] == keys
            at, found = at[known], found[known]
            open_word = np.zeros(n, bool)
            open_word[owner[at]] = True
            going = open_word[owner]
            if not going.all():
                done_symbols.append(symbols[~going])
                done_owner.append(owner[~going])
            if not len(at):
                break
            ranks, words_at = self.pair_ranks[found], owner[at]
            starts = np.flatnonzero(np.r_[True, words_at[1:] != words_at[:-1]])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(at)]))
            pick = ranks == lowest
            at, found = at[pick], found[pick]
            # of overlapping pairs (aaa) every other one counts, from the left
            heads = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
            even = place % 2 == 0
            at, found = at[even], found[even]
            symbols[at] = self.pair_merged[found]
            going[at + 1] = False
            symbols, owner = symbols[going], owner[going]
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        flat = flat[np.argsort(owner, kind="stable")]
        return flat, np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        return (ASCII_TEXT if text.isascii() else ANY_TEXT).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens, with special strings as pieces of their own."""
        if self.special_cut is None or not self.special_cut.search(text):
            return self.cut(text)
        parts = self.special_cut.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.cut(p) for i, p in enumerate(parts) if p))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts; ids of words seen before are kept up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.ids: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(vocab.size))  # the same objects in all tuples

    def learn(self, words: Iterable[str]) -> None:
        if len(self.ids) > KEPT_WORDS:
            self.ids = {}
        if not self.ids:
            self.ids = {s: (i,) for s, i in self.vocab.special.items()}
        new = list(set(words) - self.ids.keys())
        flat, begins = self.vocab.merge([w.encode() for w in new])
        flat, begins = list(map(self.numbers.__getitem__, flat.tolist())), begins.tolist()
        for k, w in enumerate(new):
            self.ids[w] = tuple(flat[begins[k] : begins[k + 1]])

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for some in portions(texts):
            cut = [self.vocab.pieces(t) for t in some]
            self.learn(chain.from_iterable(cut))
            for words in cut:
                yield list(chain.from_iterable(map(self.ids.__getitem__, words)))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process, which several tasks use one after the other."""
    return Encoder(vocabulary(path))


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in their order, in lists of about BATCH_CHARS characters."""
    some, chars = [], 0
    for t in texts:
        some.append(t)
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


def decode(vocab: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>"


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode every row of df (doc_id, text): token ids, their number, digests of ids and decoded text."""
    return _round_trip(df, path, True)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """round_trip() without the ids themselves."""
    return _round_trip(df, path, False).drop("token_ids")


def _round_trip(df: DataFrame, path: str, with_ids: bool) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    schema = pa.schema(list(zip([c.split()[0] for c in ROUND_TRIP.split(", ")], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        digits = [str(i) for i in range(vocab.size)]
        for batch in thin(batches):
            rows = []
            for ids in encoder(path).encode(texts_of(batch)):
                of_ids = hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest()
                of_text = hashlib.sha256(decode(vocab, ids).encode()).hexdigest()
                rows.append((len(ids), of_ids, of_text, np.array(ids, np.int32) if with_ids else None))
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kinds[k + 1]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select("doc_id", "text").mapInArrow(run, ROUND_TRIP)
