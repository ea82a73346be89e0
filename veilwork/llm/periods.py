"""Periodic runs of words: stretches that repeat themselves at least twice over.

Block matching by scale. A run of period q holds, in its first q words, an
aligned block of B words, B being the power of two with 2 B - 1 <= q <= 4 B - 2,
and the block stands again q words further on. So at each scale the aligned
blocks are integer sequences that an Aho-Corasick automaton searches for in the
documents, and two occurrences whose distance fits the scale are a seed. A seed
is extended in both directions: words equal to those q words on form the stretch,
and with q more words it is a run.

A block is written as the numbers that its halves got at the scale before, so keys
are short at every scale, and only blocks whose halves recur are searched for,
where both halves stand. A seed that a known run explains (inside of it, at a
multiple of its period) is skipped, as is a seed in a stretch that has been
extended at the same distance. So each stretch is walked once a distance, the
seeds of a scale are at most two for each word, and a scale takes time in
proportion to the words.

A run found at a multiple of its period is the same stretch as with its period,
so of equal stretches the smallest distance counts. Words of many documents are
numbered together, each document with numbers of its own, so nothing matches
across documents.

Edge cases: a null text counts as empty and has no words and no runs; repeated
rows give equal rows; an empty table gives an empty table; other columns are not
read. One text is never cut: it takes some 250 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.bpe import portions
from veilwork.llm.common import WORD, texts_of

#: A run has so many words at least, and REPEATS periods.
LEAST_WORDS, REPEATS = 12, 2
#: Words that all seeds of a scale are extended by at once, each way.
STEPS = 16
#: Bits of a digit of a key, so that no node of the automaton has more than 64 ways on, and places that are searched together.
DIGIT_BITS, SEARCHED = 5, 1 << 16


def least_stretch(distance: int) -> int:
    """Words that must equal those at the distance, for a run."""
    return max(distance * (REPEATS - 1), LEAST_WORDS - distance)


class Runs:
    """Runs of a sequence of word numbers: period by (start, end)."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.found: dict[tuple[int, int], int] = {}
        # of the known run over each word that reaches furthest: its end and its period
        self.reach, self.period = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)

    def explained(self, at: np.ndarray, distance: np.ndarray, size: int) -> np.ndarray:
        return (self.reach[at] >= at + distance + size) & (distance % self.period[at] == 0)

    def hopeful(self, at: np.ndarray, distance: np.ndarray, size: int) -> np.ndarray:
        """Whether the seeds' stretches are long enough, or longer than a few words more on a side."""
        ids, n = self.ids, len(self.ids)
        grown = np.full(len(at), size)
        still = np.zeros(len(at), bool)
        for to, way in ((at + size, 1), (at - 1, -1)):
            open_, to = np.arange(len(at)), to.copy()
            for _ in range(STEPS):
                here = to[open_]
                there = here + distance[open_]
                inside = (here >= 0) & (there < n)
                open_, here, there = open_[inside], here[inside], there[inside]
                open_ = open_[ids[here] == ids[there]]
                grown[open_] += 1
                to[open_] += way
                if not len(open_):
                    break
            still[open_] = True
        least = np.maximum(distance * (REPEATS - 1), LEAST_WORDS - distance)
        return still | (grown >= least)

    def _ahead(self, at: int, distance: int) -> int:
        """The first place from at on whose word differs from that at the distance."""
        ids, step = self.ids, 2 * STEPS
        last = len(ids) - distance
        while at < last:
            stop = min(last, at + step)
            differs = np.flatnonzero(ids[at:stop] != ids[at + distance : stop + distance])
            if len(differs):
                return at + int(differs[0])
            at, step = stop, 2 * step
        return max(at, 0)

    def _behind(self, at: int, distance: int) -> int:
        """The first place of the stretch that ends before at."""
        ids, step = self.ids, 2 * STEPS
        while at > 0:
            begin = max(0, at - step)
            differs = np.flatnonzero(ids[begin:at] != ids[begin + distance : at + distance])
            if len(differs):
                return begin + int(differs[-1]) + 1
            at, step = begin, 2 * step
        return 0

    def extend(self, at: np.ndarray, distance: np.ndarray, size: int) -> None:
        """Take up all runs that the seeds (a block of a size at a place, and again at a distance) lie in."""
        fresh = ~self.explained(at, distance, size)
        at, distance = at[fresh], distance[fresh]
        fresh = self.hopeful(at, distance, size)
        at, distance = at[fresh], distance[fresh]
        order = np.lexsort((at, distance))
        walked, stop = 0, 0
        for j, d in zip(at[order].tolist(), distance[order].tolist()):
            if d == walked and j < stop or self.reach[j] >= j + d + size and d % self.period[j] == 0:
                continue
            first, stop, walked = self._behind(j, d), self._ahead(j + size, d), d
            if stop - first >= least_stretch(d):
                self.add(first, stop + d, d)

    def add(self, start: int, end: int, period: int) -> None:
        known = self.found.get((start, end), period)
        self.found[start, end] = period = min(known, period)
        further = self.reach[start:end] < end
        self.reach[start:end][further] = end
        self.period[start:end][further] = period


def digits(numbers: np.ndarray, length: int) -> np.ndarray:
    """The digits of each number, the leading one first: a row for each number."""
    shifts = np.arange(length - 1, -1, -1) * DIGIT_BITS
    return (numbers[:, None] >> shifts) & ((1 << DIGIT_BITS) - 1)


def occurrences(names: np.ndarray, blocks: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sequence the blocks (starts) occur: places in order, and the number of the block there.

    names has the number of the block of half the size at each place, -1 if it has none. A key is the digits of the
    numbers of both halves; the first digit is marked, so keys match only where a place begins.
    """
    most = int(names.max()) + 1
    length = max(1, -(-(most - 1).bit_length() // DIGIT_BITS))
    first, second = np.zeros(most, bool), np.zeros(most, bool)
    first[names[blocks]] = second[names[blocks + half]] = True
    places = np.flatnonzero(names >= 0)
    places = places[places + half < len(names)]
    places = places[first[names[places]] & (names[places + half] >= 0)]
    places = places[second[names[places + half]]]

    def keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        both = np.hstack([digits(left, length), digits(right, length)])
        both[:, 0] += 1 << DIGIT_BITS
        return both

    distinct = np.unique(names[blocks] * most + names[blocks + half])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, key in enumerate(map(tuple, keys(distinct // most, distinct % most).tolist())):
        automaton.add_word(key, i)
    automaton.make_automaton()
    found_places, found_numbers = [], []
    for begin in range(0, len(places), SEARCHED):
        some = places[begin : begin + SEARCHED]
        sequence = tuple(keys(names[some], names[some + half]).ravel().tolist())
        hits = np.fromiter(chain.from_iterable(automaton.iter(sequence)), np.int64).reshape(-1, 2)
        found_places.append(some[hits[:, 0] // (2 * length)])
        found_numbers.append(hits[:, 1])
    return np.concatenate(found_places), np.concatenate(found_numbers)


def find_runs(ids: np.ndarray) -> dict[tuple[int, int], int]:
    """Period by (start, end) of all runs of a sequence of word numbers."""
    runs, n = Runs(ids), len(ids)
    for d in (1, 2):  # scale 1: blocks of one word
        at = np.flatnonzero(ids[:-d] == ids[d:]) if n > d else np.zeros(0, np.int64)
        runs.extend(at, np.full(len(at), d), 1)
    names = np.where(np.bincount(ids)[ids] > 1, ids, -1) if n else ids
    size = 2
    while 2 * (2 * size - 1) <= n:
        half = size // 2
        blocks = np.arange(0, n - size + 1, size)
        blocks = blocks[(names[blocks] >= 0) & (names[blocks + half] >= 0)]
        if not len(blocks):
            break
        places, numbers = occurrences(names, blocks, half)
        often = np.bincount(numbers)[numbers] > 1
        places, numbers = places[often], numbers[often]
        names = np.full(n, -1)
        names[places] = numbers
        blocks = blocks[names[blocks] >= 0]
        ordered = np.sort(numbers * n + places)
        own = names[blocks] * n
        low = np.searchsorted(ordered, own + np.minimum(blocks + 2 * size - 1, n), side="left")
        high = np.searchsorted(ordered, own + np.minimum(blocks + 4 * size - 2, n - 1), side="right")
        some = np.maximum(high - low, 0)
        at = np.repeat(blocks, some)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(some) - some, some)
        runs.extend(at, ordered[np.repeat(low, some) + nth] % n - at, size)
        size *= 2
    return runs.found


def numbered_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal within a document where words are and never across documents; and each word's document."""
    sizes = np.array([len(w) for w in docs], np.int64)
    fresh = count()
    known: dict[bytes, int] = {}
    flat = np.fromiter((known[w] if w in known else known.setdefault(w, next(fresh)) for w in chain.from_iterable(docs)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(docs)), sizes)
    return np.unique(doc * max(1, len(known)) + flat, return_inverse=True)[1], doc


def collapsed(docs: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Of each document its runs (start, length, period), in order, and its words without what runs repeat."""
    ids, doc = numbered_words(docs)
    begins = np.cumsum([0, *map(len, docs)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    dropped = np.zeros(len(ids) + 1, np.int64)
    for (start, end), period in find_runs(ids).items():
        d = int(doc[start])
        runs[d].append((start - int(begins[d]), end - start, period))
        dropped[start + period] += 1
        dropped[end] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    for d, words in enumerate(docs):
        own = sorted(runs[d], key=lambda r: (r[0], r[2]))
        left = [w for w, good in zip(words, kept[begins[d] : begins[d + 1]].tolist()) if good] if own else words
        yield own, b" ".join(left)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(df: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (in the order of start and period) and collapsed text of every row of df (doc_id, text)."""
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, left = [], [], []
            for some in portions(texts_of(batch)):
                docs = [t.encode().split() for t in some]
                for words, (own, text) in zip(docs, collapsed(docs)):
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    left.append(text.decode())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """doc_id and text of df, a tenth of the texts made periodic from some word on; ids decide which, where and how."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = df.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = words.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("words")
    some = words.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i))), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of every row of find(): the number of runs, the longest one (ties: smallest start, then period), digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.withColumn("best", best)
    length, period = F.col("best.l"), -F.col("best.p")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
