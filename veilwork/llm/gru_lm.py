"""LM scoring with a gated recurrent network in numpy.

The network reads words and predicts the next one by a class-factored softmax:
first the class, then the word within it. Frequent words have places of their
own; all others share one class, within which the corpus counts decide.

Texts are cut into words once, after the counts, and stored as numbers. Training
is truncated backpropagation over every word of every training document: lanes
take segments (of up to SEGMENT words) and carry the state from window to
window. Segments are dealt by a hash of what they hold to ROUNDS rounds and to
shards, whose number follows the words of the corpus; each shard trains a copy
in the order of the hash, and the copies are averaged in the order of shards, so
neither the files' layout nor the order of rows tells in the result. Documents
are scored whole: many at a time in lanes, window after window, with the state
carried along. Arrays have lanes or words last, so that numpy's loops are long.

Counts cover every word of every training document. The most frequent words and
their counts, a bounded number of bounded length, go to the workers; the counts
of the others meet the documents in a join by word.

Edge cases: a null text counts as empty and has just its end; repeated rows give
equal rows; an empty table gives an empty table; without training rows all
counts are zero; other columns are not read. A row without doc_id trains.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veilwork.llm.common import stored, utf8_of

END = b""  # the token at the end of every text; no word is empty
FOLDS, HELD_OUT = 7, 2
#: Width of the state, words per class, and classes of frequent words.
HIDDEN, CLASS_WORDS, CLASSES = 16, 32, 32
#: Frequent words whose counts go to every worker, and the longest of them in bytes.
KNOWN_WORDS, KNOWN_BYTES = 100_000, 64
COUNT_STEPS = 16  # of a doubling of counts
#: Words of a document through which training carries the state, rounds, and the step size. Each segment trains in one round.
SEGMENT, ROUNDS, STEP = 1024, 2, 0.02
#: Training words of the corpus to a shard, copies (of 270 KB) that are averaged together, and words that wait together.
SHARD_WORDS, AVERAGED, GROUP_WORDS = 2_000_000, 32, 1_000_000
#: Steps of a window, and lanes in training and in scoring.
TRAIN_WINDOW, TRAIN_LANES, WINDOW, LANES = 16, 512, 32, 512
#: Distinct words that a task counts before it hands them on, bytes of text numbered together, and words scored together.
COUNTED_WORDS, NUMBERED_BYTES, SCORED_WORDS = 300_000, 1_000_000, 4_000_000


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens_of(text: bytes) -> list[bytes]:
    """Words in UTF-8, ASCII letters in lower case, and the end."""
    return [*text.lower().split(), END]


@dataclass
class Network:
    """Weights; the word with number i is word i % CLASS_WORDS of class i // CLASS_WORDS."""

    inputs: np.ndarray  # a row for each word, for all rare ones, and for the start of a text; three gates each
    gates: np.ndarray
    gate_bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    @staticmethod
    def start(counts: list[int], rare: int) -> Network:
        """Small fixed weights; the biases give the counts' own distribution."""
        rng, n = np.random.default_rng(7), CLASSES * CLASS_WORDS
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        of_word = np.zeros(n)
        of_word[: len(counts)] = counts
        table = (of_word + 0.5).reshape(CLASSES, CLASS_WORDS)
        table[of_word.reshape(table.shape) == 0] = 1e-6
        totals = np.r_[table.sum(1), rare + 0.5]
        return Network(
            small(n + 2, 3 * HIDDEN),
            small(HIDDEN, 3 * HIDDEN),
            np.zeros(3 * HIDDEN, np.float32),
            small(HIDDEN, CLASSES + 1) * 0,
            np.log(totals / totals.sum()).astype(np.float32),
            small(CLASSES, HIDDEN, CLASS_WORDS) * 0,
            np.log(table / table.sum(1, keepdims=True)).astype(np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pack(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in self.arrays())

    def unpack(self, data: bytes) -> Network:
        flat, out, at = np.frombuffer(data, "<f4"), [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


RARE = CLASSES * CLASS_WORDS
START = RARE + 1


def _step(net: Network, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The next state; a lane to a row."""
    return _states(net, np.ascontiguousarray(h.T), x[None])[:, 0].T


@dataclass
class Kept:
    """What backpropagation needs of a window: steps, then gates or width, then lanes."""

    gates: np.ndarray  # update, then reset
    candidate: np.ndarray
    recurrent: np.ndarray  # what the state adds to the candidate before the reset

    @staticmethod
    def room(steps: int, lanes: int, kind: np.dtype) -> Kept:
        return Kept(*(np.empty((steps, n * HIDDEN, lanes), kind) for n in (2, 1, 1)))


def _states(net: Network, h: np.ndarray, x: np.ndarray, kept: Kept | None = None) -> np.ndarray:
    """The state after each row of x: width, steps, lanes. h has a lane to a column."""
    half = np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(net.gates.dtype)  # sigmoid(x) = (tanh(x / 2) + 1) / 2
    table, gates = (net.inputs + net.gate_bias) * half, np.ascontiguousarray((net.gates * half).T)
    steps, lanes = x.shape
    out = np.empty((HIDDEN, steps, lanes), h.dtype)
    a, u = np.empty((3 * HIDDEN, lanes), h.dtype), np.empty((3 * HIDDEN, lanes), h.dtype)
    room = kept or Kept.room(1, lanes, h.dtype)
    for t in range(steps):
        zr, n, un = (k[t if kept else 0] for k in (room.gates, room.candidate, room.recurrent))
        a[...] = table[x[t]].T
        np.matmul(gates, h, out=u)
        un[...] = u[2 * HIDDEN :]
        np.add(a[: 2 * HIDDEN], u[: 2 * HIDDEN], out=zr)
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        np.multiply(zr[HIDDEN:], un, out=n)
        n += a[2 * HIDDEN :]
        np.tanh(n, out=n)
        new = out[:, t]
        np.subtract(h, n, out=new)
        new *= zr[:HIDDEN]
        new += n
        h = new
    return out


def _softmax(x: np.ndarray, at: np.ndarray, shares: bool = False) -> np.ndarray:
    """The logarithm of each column's share at a place. x is used up; with shares it then holds the shares."""
    x -= x.max(axis=0)
    out = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if shares:
        x /= total
    return out - np.log(total)


def _class_of(y: np.ndarray) -> np.ndarray:
    return np.minimum(y // CLASS_WORDS, CLASSES).astype(np.uint8)


def _by_class(cls: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Frequent classes that occur, and where they stand in sorted cls."""
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        if bounds[c] < bounds[c + 1]:
            yield c, slice(bounds[c], bounds[c + 1])


def log_likelihoods(net: Network, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each y after the state in the same row of h."""
    return _log_likelihoods(net, h.T, y)


def _log_likelihoods(net: Network, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same with a state to a column."""
    order = np.argsort(_class_of(y), kind="stable")
    h, y = np.take(h, order, axis=1), y[order]
    cls = _class_of(y)
    d = net.classes.T @ h
    d += net.class_bias[:, None]
    logs = _softmax(d, cls)
    for c, at in _by_class(cls):
        d = net.words[c].T @ h[:, at]
        d += net.word_bias[c][:, None]
        logs[at] += _softmax(d, y[at] - c * CLASS_WORDS)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def gradients(net: Network, h: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over a window, the state after it, and the loss; no gradient goes into h.

    x, y, there: inputs, what follows, and whether it counts; steps by lanes.
    """
    steps, lanes = x.shape
    before, kind = np.ascontiguousarray(h.T), net.gates.dtype
    kept = Kept.room(steps, lanes, kind)
    states = _states(net, before, x, kept)
    flat = states.reshape(HIDDEN, -1)
    on = np.flatnonzero(there.ravel())
    order = np.argsort(_class_of(y.ravel()[on]), kind="stable")
    on, n = on[order], max(1, len(on))
    hs, ys = np.take(flat, on, axis=1), y.ravel()[on]
    cls = _class_of(ys)
    d = net.classes.T @ hs
    d += net.class_bias[:, None]
    loss = -_softmax(d, cls, True).sum()
    d[cls, np.arange(len(on))] -= 1
    g_classes, g_class_bias = hs @ d.T, d.sum(1)
    dh_on = net.classes @ d
    g_words, g_word_bias = np.zeros_like(net.words), np.zeros_like(net.word_bias)
    for c, rows in _by_class(cls):
        own, at = hs[:, rows], ys[rows] - c * CLASS_WORDS
        d = net.words[c].T @ own
        d += net.word_bias[c][:, None]
        loss -= _softmax(d, at, True).sum()
        d[at, np.arange(len(at))] -= 1
        g_words[c], g_word_bias[c] = own @ d.T, d.sum(1)
        dh_on[:, rows] += net.words[c] @ d
    dhs = np.zeros_like(flat)
    dhs[:, on] = dh_on
    dhs = dhs.reshape(states.shape)
    # of the gates' recurrent sides; the candidate's input side differs from its recurrent one
    dus, dns, dh = np.empty((3 * HIDDEN, steps, lanes), kind), np.empty((HIDDEN, steps, lanes), kind), np.zeros_like(before)
    for t in range(steps - 1, -1, -1):
        z, r, cand = kept.gates[t, :HIDDEN], kept.gates[t, HIDDEN:], kept.candidate[t]
        dz, dr, du, dn = dus[:HIDDEN, t], dus[HIDDEN : 2 * HIDDEN, t], dus[2 * HIDDEN :, t], dns[:, t]
        dh += dhs[:, t]
        through = dh * z
        np.subtract(dh, through, out=dn)
        dn -= dn * (cand * cand)
        np.subtract(states[:, t - 1] if t else before, cand, out=dz)
        dz *= through
        dz -= dz * z
        np.multiply(dn, r, out=du)
        np.multiply(du, kept.recurrent[t], out=dr)
        dr -= dr * r
        np.matmul(net.gates, dus[:, t], out=dh)
        dh += through
    last = np.concatenate([before[:, None], states[:, :-1]], axis=1).reshape(HIDDEN, -1)
    g_gates = last @ dus.reshape(3 * HIDDEN, -1).T
    dus[2 * HIDDEN :] = dns
    das, words = dus.reshape(3 * HIDDEN, -1), x.ravel()
    g_inputs = np.stack([np.bincount(words, g, len(net.inputs)) for g in das], axis=1).astype(kind)
    grads = [g_inputs, g_gates, das.sum(1), g_classes, g_class_bias, g_words, g_word_bias]
    return [g / n for g in grads], states[:, -1].T, float(loss)


@dataclass
class Window:
    """The next words of the texts in all lanes; x, y, there: inputs, what follows, and whether it counts, steps by lanes."""

    text: np.ndarray
    h: np.ndarray
    x: np.ndarray
    y: np.ndarray
    there: np.ndarray
    after: np.ndarray | None = None  # the state to go on with


def windows(texts: list[np.ndarray], before: list[int], lanes: int, steps: int) -> Iterator[Window]:
    """All words of the texts, which take the lanes in their order; before: what comes before each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    flat = np.concatenate(texts)
    last = np.r_[START, flat[:-1]].astype(flat.dtype)
    last[begins] = before
    own, place, h, new = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((HIDDEN, 0), np.float32), 0
    while new < len(texts) or len(own):
        fresh = np.arange(new, min(len(texts), new + lanes - len(own)))
        new += len(fresh)
        own, place = np.r_[own, fresh], np.r_[place, begins[fresh]]
        h = np.concatenate([h, np.zeros((HIDDEN, len(fresh)), np.float32)], axis=1)
        at = place + np.arange(steps)[:, None]
        there = at < ends[own]
        at = np.where(there, at, 0)
        w = Window(own, h, last[at], flat[at], there)
        yield w
        place = place + steps
        on = place < ends[own]
        own, place, h = own[on], place[on], w.after[:, on]


class Trainer:
    """Truncated backpropagation with Adam steps."""

    def __init__(self, net: Network):
        self.net = net
        self.first = [np.zeros_like(a) for a in net.arrays()]
        self.second = [np.zeros_like(a) for a in net.arrays()]
        self.steps = 0
        self.words = 0

    def train(self, segments: list[tuple[int, np.ndarray]]) -> float:
        """A step for each window of up to TRAIN_LANES segments: (the word before, words). Returns the loss."""
        loss = 0.0
        for w in windows([words for _, words in segments], [before for before, _ in segments], TRAIN_LANES, TRAIN_WINDOW):
            grads, after, lost = gradients(self.net, w.h.T, w.x, w.y, w.there)
            w.after = after.T
            n = int(w.there.sum())
            self._move(grads, n / (TRAIN_LANES * TRAIN_WINDOW))  # a window that is not full moves less
            self.words += n
            loss += lost
        return loss

    def _move(self, grads: list[np.ndarray], share: float) -> None:
        self.steps += 1
        scale = STEP * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for a, g, m, v in zip(self.net.arrays(), grads, self.first, self.second):
            g = g * np.float32(share)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each document's words and end, rare ones as their class."""
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))  # the longest first: then lanes end together
    total = np.zeros(len(docs))
    for w in windows([docs[k] for k in order], [START] * len(docs), LANES, WINDOW):
        states = _states(net, w.h, w.x)
        w.after = states[:, -1]
        there = np.flatnonzero(w.there.ravel())
        logp = _log_likelihoods(net, np.take(states.reshape(HIDDEN, -1), there, axis=1), w.y.ravel()[there])
        total += np.bincount(w.text[there % len(w.text)], weights=logp, minlength=len(docs))
    out = np.empty(len(docs))
    out[order] = total
    return out / math.log(10)


def count_words(df: DataFrame) -> DataFrame:
    """word and n: how often it occurs in training rows of df (doc_id, text); the end counts too."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(counts.keys()), pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8_of(batch)):
                if not is_held_out(doc_id):
                    counts.update(tokens_of(text))
                    if len(counts) > COUNTED_WORDS:
                        yield out()
                        counts.clear()
        yield out()

    found = df.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words: the first RARE have places in the network."""

    counts: dict[str, int]
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.place = {w.encode(): i for i, w in enumerate(list(self.counts)[:RARE])}
        self.placed = sum(list(self.counts.values())[:RARE])

    def numbers(self, tokens: list[bytes]) -> list[int]:
        place = self.place
        return [place.get(t, RARE) for t in tokens]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words of the highest counts, as many as fit into KNOWN_WORDS without parting a step of counts.

    A top-k would send k rows of every task to the driver. Here a histogram in steps of counts (a few hundred rows)
    tells which count to ask for, and only words from there on are sent.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * COUNT_STEPS).cast("int")
    short = counts.where(F.octet_length("word") <= KNOWN_BYTES).withColumn("step", step)
    least, words = None, 0
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        words += r["count"]
        if words > KNOWN_WORDS:
            break
        least = r["step"]
    top = [] if least is None else short.where(F.col("step") >= least).select("word", "n").collect()
    return Vocabulary({r["word"]: r["n"] for r in sorted(top, key=lambda r: (-r["n"], r["word"]))}, total, distinct)


NUMBERED = """row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_logs double, n_rare long,
 rare_logs double, numbers binary, others array<struct<word: string, n: long>>"""


def numbered(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """What a worker can tell of each row: its words by number, two bytes each, and words whose counts it does not have."""
    names = [c.split()[0] for c in NUMBERED.replace("<word: string, n: long>", "").split(",")]

    def rows_of(codes: dict[bytes, int], logs: np.ndarray, keys: list, texts: list[bytes]) -> pa.RecordBatch:
        """All texts at once; logs ends with a zero, which unknown words (-1) get."""
        parts = [tokens_of(text) for text in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(codes.get, flat, repeat(-1)), np.int64, len(flat))
        numbers = np.where(at < 0, RARE, np.minimum(at, RARE)).astype("<u2")
        per_row = lambda x: np.add.reduceat(x, ends - sizes)  # noqa: E731 (no row is without tokens)
        of_known = logs[at]
        strange = np.flatnonzero(at < 0).tolist()
        bounds, words, times, offsets = np.searchsorted(strange, np.r_[0, ends]).tolist(), [], [], [0]
        for begin, end in pairwise(bounds):
            own = Counter(flat[i] for i in strange[begin:end])
            words += own.keys()
            times += own.values()
            offsets.append(len(words))
        other = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])
        columns = [
            *(pa.array(k, pa.int64()) for k in keys),
            pa.array([is_held_out(doc_id) for doc_id in keys[1]], pa.bool_()),
            pa.array(sizes),
            pa.array(per_row((at >= 0).astype(np.int64))),
            pa.array(per_row(of_known)),
            pa.array(per_row((numbers == RARE).astype(np.int64))),
            pa.array(per_row(np.where(at >= RARE, of_known, 0.0))),
            pa.array([numbers[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), other),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {w.encode(): i for i, w in enumerate(vocab.counts)}
        logs = np.r_[np.log10(np.array([*vocab.counts.values()], float) + 1), 0.0]
        for batch in batches:
            keys = [batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()]
            texts, begin, size = utf8_of(batch), 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= NUMBERED_BYTES or k + 1 == len(texts):
                    yield rows_of(codes, logs, [c[begin : k + 1] for c in keys], texts[begin : k + 1])
                    begin, size = k + 1, 0

    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, NUMBERED)


def segments(rows: DataFrame, shards: int) -> DataFrame:
    """Every training word of rows (doc_id, held_out, numbers) once: round, shard, hash, numbers, and the word before them.

    The hash is of a row's id and words and of the segment's place, so equal ones are equal segments.
    """
    size = F.lit(2 * SEGMENT)
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("numbers") / size).cast("int") - 1))
    cut = rows.where("not held_out").select("doc_id", "numbers", k.alias("k"))
    begin = F.col("k") * size
    cut = cut.select(
        F.xxhash64("doc_id", "numbers", "k").alias("hash"),
        F.substring("numbers", begin + 1, size).alias("numbers"),
        F.when(F.col("k") > 0, F.substring("numbers", begin - 1, F.lit(2))).alias("before"),
    )
    dealt = F.pmod("hash", F.lit(ROUNDS * shards))
    return cut.select((dealt % ROUNDS).alias("round"), F.floor(dealt / ROUNDS).cast("int").alias("shard"), "hash", "numbers", "before")


def train(rows: DataFrame, vocab: Vocabulary) -> Network:
    """The network after ROUNDS rounds over rows of numbered(); shards train on their own and are averaged."""
    net = Network.start(list(vocab.counts.values())[:RARE], vocab.total - vocab.placed)
    schema = pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("weights", pa.binary())])
    shown = "shard int, words long, weights binary"
    shards = max(1, -(-vocab.total // SHARD_WORDS))
    every = segments(rows, shards)

    def row_of(shard: int, words: int, weights: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, words, weights), schema)], schema=schema)

    def mean_of(found: list[tuple[int, int, bytes]]) -> tuple[int, bytes]:
        """Words and averaged weights of (shard, words, weights), in the order of shards."""
        total = sum(n for _, n, _ in found)
        mean = sum(np.frombuffer(w, "<f4").astype(float) * (n / total) for _, n, w in sorted(found))
        return total, mean.astype("<f4").tobytes()

    def average(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(r["shard"], r["words"], r["weights"]) for batch in batches for r in batch.to_pylist()]
        yield row_of(key[0].as_py(), *mean_of(found))

    for round_ in range(ROUNDS):
        packed = net.pack()

        def run(batches: Iterator[pa.RecordBatch], packed: bytes = packed) -> Iterator[pa.RecordBatch]:
            shard, trainer = None, Trainer(net)
            waiting: list[tuple[int, np.ndarray]] = []
            words = 0

            def done() -> Iterator[pa.RecordBatch]:
                if waiting:
                    trainer.train(waiting)
                if trainer.words:
                    yield row_of(shard, trainer.words, trainer.net.pack())

            for batch in batches:
                columns = (batch.column(k).to_pylist() for k in ("shard", "numbers", "before"))
                for own, numbers, before in zip(*columns):
                    if own != shard:
                        yield from done()
                        shard, trainer, waiting, words = own, Trainer(net.unpack(packed)), [], 0
                    waiting.append((int.from_bytes(before, "little") if before else START, np.frombuffer(numbers, "<u2")))
                    words += len(numbers) // 2
                    if words >= GROUP_WORDS:
                        trainer.train(waiting)
                        waiting, words = [], 0
            yield from done()

        mine = every.where(F.col("round") == round_).select("shard", "hash", "numbers", "before")
        mine = mine.repartitionById(shards, "shard").sortWithinPartitions("shard", "hash")
        trained = mine.select("shard", "numbers", "before").mapInArrow(run, shown)
        # shards follow the words, so copies are averaged in as many levels as bring them down to what the driver averages
        left = shards
        while left > AVERAGED:
            trained = trained.groupBy(F.floor(F.col("shard") / AVERAGED).cast("int").alias("part")).applyInArrow(average, shown)
            left = -(-left // AVERAGED)
        means = trained.collect()
        if means:
            net = net.unpack(mean_of([(r["shard"], r["words"], bytes(r["weights"])) for r in means])[1])
    return net


TOLD = ("row", "doc_id", "held_out", "n_tokens", "n_known", "known_logs", "n_rare", "rare_logs")


def with_scores(rows: DataFrame, net: Network) -> DataFrame:
    """rows of numbered() with net_score: log10 of the probability of their numbers."""
    packed, empty = net.pack(), Network.start([], 0)
    told = rows.select(*TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = empty.unpack(packed)
        for batch in batches:
            docs, begin, words = [], 0, 0
            for k, numbers in enumerate(batch.column("numbers")):
                docs.append(np.frombuffer(numbers.as_py(), "<u2"))
                words += len(docs[-1])
                if words >= SCORED_WORDS or k + 1 == batch.num_rows:
                    part = batch.select(list(TOLD)).slice(begin, len(docs))
                    yield part.append_column("net_score", pa.array(score(net, docs), pa.float64()))
                    docs, begin, words = [], k + 1, 0

    return rows.select(*TOLD, "numbers").mapInArrow(run, StructType([*told.schema.fields, StructField("net_score", DoubleType())]))


def score_documents(df: DataFrame) -> DataFrame:
    """Counts, unigram base and the network's log10 probability of every row of df (doc_id, text)."""
    counts = stored(count_words(df))
    vocab = vocabulary(counts)
    rows = stored(numbered(df, vocab))
    scored = with_scores(rows, train(rows, vocab))
    words = rows.select("row", F.explode("others").alias("other")).select("row", "other.word", F.col("other.n").alias("times"))
    met = words.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    logs = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("other_logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("other_known"),
    )
    rare_words = vocab.distinct - len(vocab.place)
    of_all, of_rare = math.log10(vocab.total + vocab.distinct + 1), math.log10(vocab.total - vocab.placed + rare_words + 1)
    other = F.coalesce("other_logs", F.lit(0.0))
    return scored.join(logs, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("other_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("known_logs") + other - F.col("n_tokens") * F.lit(of_all)).alias("base_score"),
        (F.col("net_score") + F.col("rare_logs") + other - F.col("n_rare") * F.lit(of_rare)).alias("score"),
    )
