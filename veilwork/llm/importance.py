"""Importance resampling towards a target by hashed runs of words.

A byte automaton walks the UTF-8 buffer of an Arrow column as a whole. A lookup
table lowers A-Z and gives each byte its class; words begin and end where the
class differs from the byte before, or where a text ends. The CRC-32 of all
words advances by one byte of each word at a time, by table, longest words
first, so that those still running are a prefix of the arrays. A run of several
words goes on from the state behind its first ones, over a blank and the next.

Counts of buckets over all texts and over the target give each bucket a gain;
a text's weight is the sum of gains over its runs. Gumbel noise from a hash of
the id turns the weights into a draw without replacement of the highest scores.
Only slim rows (no texts) are ranked, by range parts.

Edge cases: a null text has no words, weight 0, and is never drawn while there
must be words; a null id hashes as the empty text and loses ties; rows that
share id and score get ranks next to each other, and of repeated rows at the end
of the draw only as many are drawn as fit; an empty table gives an empty table,
and an empty target gains by counts of 0; other columns are not read. A batch of
texts is handled in slices of about SLICE_BYTES; one text is never cut, and takes
some 60 bytes of memory for each byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import stored
from veilwork.operators.ranks import numbered

#: The reversed polynomial of CRC-32, and bytes of text whose words advance together.
POLYNOMIAL, SLICE_BYTES = 0xEDB88320, 1 << 20
#: Below so many words that still run, each is finished by itself.
FEW = 8


@dataclass(frozen=True)
class Plan:
    """Words of a run at most, buckets, words that a drawn text must have, percent of those texts that are drawn, seed of the noise."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def lowered() -> np.ndarray:
    """Each byte in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def word_bytes() -> np.ndarray:
    """Whether each (lowered) byte belongs to a word: digits, letters, and all of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = table[ord("a") : ord("z") + 1] = table[128:] = True
    return table


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


LOWER, IN_WORD, CRC = lowered(), word_bytes(), crc_table()


def words_of(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lowered bytes, of which text i ends at ends[i]."""
    inside = np.zeros(len(values) + 1, bool)
    inside[:-1] = IN_WORD[values]
    changes = np.empty(len(values) + 1, bool)
    changes[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=changes[1:])
    starts, stops = changes & inside, changes & ~inside
    # a text may end within what looks like one word
    cut = ends[(ends > 0) & (ends < len(values))]
    cut = cut[inside[cut - 1] & inside[cut]]
    starts[cut] = stops[cut] = True
    return np.flatnonzero(starts), np.flatnonzero(stops)


def advanced(state: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes from each start on, all starts at once."""
    order = np.argsort(-sizes, kind="stable")
    state, at = state[order], starts[order]
    # running[k]: words with more than k bytes
    longest = int(sizes[order[0]]) if len(order) else 0
    running = len(order) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
    for k in range(longest):
        n = int(running[k])
        if n < FEW:
            for i in range(n):
                state[i] = _finished(state[i], values[at[i] + k : at[i] + sizes[order[i]]])
            break
        s = state[:n]
        state[:n] = CRC[(s ^ values[at[:n] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def _finished(state: np.uint32, rest: np.ndarray) -> int:
    table, s = _CRC_LIST, int(state)
    for b in rest.tobytes():
        s = table[(s ^ b) & 255] ^ (s >> 8)
    return s


_CRC_LIST = CRC.tolist()


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lowered bytes, and the end of each text in them, of a column of texts; nulls are empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, side="right")) - 1)
        yield LOWER[values[ends[begin] : ends[stop]]], ends[begin + 1 : stop + 1] - ends[begin]
        begin = stop


def features(values: np.ndarray, ends: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of words, the text of each, and the number of words of each text."""
    starts, stops = words_of(values, ends)
    doc = np.searchsorted(ends, starts, side="right")
    sizes = stops - starts
    state = advanced(np.full(len(starts), 0xFFFFFFFF, np.uint32), values, starts, sizes)
    found, owners, more = [], [], np.arange(len(starts))
    for n in range(1, plan.longest + 1):
        if n > 1:
            # every run goes on over the next word; those that it leads into another text are not counted
            blank = CRC[(state[:-1] ^ np.uint32(32)) & np.uint32(255)] ^ (state[:-1] >> np.uint32(8))
            state = advanced(blank, values, starts[n - 1 :], sizes[n - 1 :])
            more = np.flatnonzero(doc[: len(state)] == doc[n - 1 :])
        found.append(((state[more] ^ np.uint32(0xFFFFFFFF)) % np.uint32(plan.buckets)).astype(np.int64))
        owners.append(doc[more])
    return np.concatenate(found), np.concatenate(owners), np.bincount(doc, minlength=len(ends))


def bucket_counts(df: DataFrame, plan: Plan) -> DataFrame:
    """bucket and n, how many runs of words of all texts of df fall into it; a task sends a row for each bucket at most."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for batch in batches:
            for values, ends in slices(batch.column("text")):
                total += np.bincount(features(values, ends, plan)[0], minlength=plan.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)

    return df.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(df: DataFrame, target: DataFrame, plan: Plan) -> np.ndarray:
    """Of each bucket floor(1000 ln of how much more often the target has it), with one added to every count.

    The driver gets a row for each bucket of either side, so plan.buckets bounds them.
    """
    sides = []
    for side in (df, target):
        counts = np.zeros(plan.buckets, np.int64)
        for r in bucket_counts(side, plan).collect():
            counts[r["bucket"]] = r["n"]
        sides.append(counts.tolist())
    ours, theirs = sides
    s_all, t_all = sum(ours) + plan.buckets, sum(theirs) + plan.buckets
    ratio = lambda s, t: float(t + 1) * float(s_all) / (float(s + 1) * float(t_all))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(ours, theirs)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, plan: Plan) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of df (doc_id, text)."""
    kinds = [("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], []]
            for values, ends in slices(batch.column("text")):
                bucket, owner, words = features(values, ends, plan)
                total = np.zeros(len(ends), np.int64)
                np.add.at(total, owner, gain[bucket])
                for part, own in zip(parts, (words, np.bincount(owner, minlength=len(ends)), total)):
                    part.append(own.astype(np.int64))
            columns = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(k for k, _ in kinds)])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 8 hex digits of a hash of seed and id."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), own), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(df: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of df (doc_id, text).

    target (text) is what the draw should look like.
    """
    scored = weights(df, gains(df, target, plan), plan)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), plan.seed)))
    able = F.coalesce(F.col("n_words") >= plan.least_words, F.lit(False))
    wanted = scored.where(able).count() * plan.percent // 100
    ranked = numbered(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of df whose id is drawn, with all their columns; rows that share an id stay or go together.

    A hot id is one key of a semi join, whose other side has a row for each id.
    """
    taken = drawn(df, target, plan).where("rank is not null").select(F.col("doc_id").alias("_taken")).distinct()
    return df.join(taken, df["doc_id"].eqNullSafe(taken["_taken"]), "left_semi")
