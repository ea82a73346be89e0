"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint has a nonzero vector of RADIUS + 1 binary digits. A
table belongs to each nonzero vector v and keeps the bits whose vectors are not
orthogonal to v. Up to RADIUS differing bits span too little to exclude every v,
so some table keeps none of them: each pair within the radius collides there.

Fingerprints are made distinct first. Within a bucket links become stars around
the smallest member, never all pairs: small buckets are compared directly,
larger ones are dealt again by covering masks over the bits that still differ.
Buckets over HOT are dealt again before they reach a task, after which at most
as many distinct members are left as the remaining free bits can tell apart.

Edge cases: a null text counts as empty; texts without words have fingerprint
zero and link like any others; repeated rows give equal rows; an empty table
gives an empty table; other columns are not read. Rows without doc_id get a
component from the other rows of their class, null if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilwork.llm.common import stored, unwrapped, utf8_of, wrapped

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Members of a bucket that are compared directly, and over which a bucket is dealt again across tasks.
DIRECT, HOT = 1024, 20_000
#: Shingles that are hashed and whose bits are counted at once.
BLOCK = 1 << 16


def masks(level: int = 0) -> list[int]:
    """The covering masks over all bits; levels give the bits different vectors."""
    n = 2 ** (RADIUS + 1) - 1
    vectors = [1 + (i * (2 * level + 1) + level * (i // n)) % n for i in range(BITS)]
    if level:
        vectors = [1 + (v * (level + 2) + i // 2) % n for i, v in enumerate(vectors)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - WORDS + 1)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        own = words[k : k + BLOCK + WORDS - 1]
        if len(own) <= WORDS:
            hashes = [hashed(b" ".join(own), SEED)]
        else:
            joined, ends = b" ".join(own), list(accumulate(len(w) + 1 for w in own))
            hashes = [hashed(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[WORDS - 1 :])]
        some = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame) -> DataFrame:
    """df (text and others) with the fingerprint of the text in its place: fp, the bits as a signed long."""
    others = [f for f in df.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in utf8_of(batch)], np.uint64).view(np.int64)
            yield batch.select([f.name for f in others]).append_column("fp", pa.array(fp))

    return df.mapInArrow(run, StructType([*others, StructField("fp", LongType())]))


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _dealt(df: DataFrame, level: int, table: str, key: str) -> DataFrame:
    """A row for each fingerprint and table of a level."""
    entries = [F.struct(F.lit(t).alias(table), F.col("fp").bitwiseAND(_signed(m)).alias(key)) for t, m in enumerate(masks(level))]
    return df.select("*", F.explode(F.array(*entries)).alias("entry")).select(*df.columns, f"entry.{table}", f"entry.{key}")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _near(fps: np.ndarray) -> np.ndarray:
    """Of each fingerprint the first one that it is connected with; all are compared."""
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
    labels = np.arange(len(fps))
    while True:
        new = np.where(close, labels[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def connect(fps: np.ndarray, level: int = 1) -> np.ndarray:
    """Of each of the distinct sorted fingerprints the place of the smallest that it is connected with."""
    if len(fps) <= DIRECT:
        return _near(fps)
    union = _Union(len(fps))
    for mask in masks(level):
        keys = fps & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            own = order[a:b]
            if b - a < 2 or len({union.root(i) for i in own.tolist()}) == 1:
                continue
            if b - a == len(fps):  # nothing told apart: all that differ lie in the other bits
                local = _near_blocks(fps)
            else:
                local = connect(fps[own], level + 1)
            for i, j in zip(own.tolist(), own[local].tolist()):
                if i != j:
                    union.join(i, j)
    return np.array([union.root(i) for i in range(len(fps))])


def _near_blocks(fps: np.ndarray) -> np.ndarray:
    """As _near, a block of rows at a time."""
    union = _Union(len(fps))
    for a in range(0, len(fps), 256):
        i, j = np.nonzero(np.bitwise_count(fps[a : a + 256, None] ^ fps[None, :]) <= RADIUS)
        for x, y in zip((i + a).tolist(), j.tolist()):
            if x < y:
                union.join(x, y)
    return np.array([union.root(i) for i in range(len(fps))])


def _linked(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Stars (a, b) of the buckets: b is the smallest fingerprint of those that a is connected with there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table: pa.Table) -> pa.RecordBatch:
        fps = table.column("fp").to_numpy()
        changed = np.zeros(max(0, len(fps) - 1), bool)
        for k in keys:
            x = table.column(k).to_numpy()
            changed |= x[1:] != x[:-1]
        cuts = np.r_[0, np.flatnonzero(changed) + 1, len(fps)]
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in np.flatnonzero(np.diff(cuts) > 1).tolist():
            own = np.unique(fps[cuts[g] : cuts[g + 1]].view(np.uint64))
            to = connect(own)
            moved = np.flatnonzero(to != np.arange(len(own)))
            out_a.append(own[moved].view(np.int64))
            out_b.append(own[to[moved]].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = table.slice(table.num_rows - 1, 1)
            same = np.ones(table.num_rows, bool)
            for k in keys:
                same &= table.column(k).to_numpy() == last.column(k)[0].as_py()
            begin = int(np.argmax(same)) if table.num_rows else 0  # rows are sorted: the last bucket may go on
            if begin:
                yield links(table.slice(0, begin))
            rest = table.slice(begin)
        if rest is not None and rest.num_rows:
            yield links(rest)

    dealt = dealt.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """Stars (a, b) that connect the distinct fingerprints fp of nodes within RADIUS bits."""
    first = _dealt(nodes.select("fp"), 0, "t", "key")
    hot = stored(first.groupBy("t", "key").count().where(F.col("count") > HOT))
    if hot.isEmpty():
        found = _linked(first, ["t", "key"])
    else:
        cold = _linked(first.join(hot, ["t", "key"], "left_anti"), ["t", "key"])
        again = _dealt(first.join(hot.select("t", "key"), ["t", "key"]), 1, "t2", "key2")
        found = cold.union(_linked(again, ["t", "key", "t2", "key2"]))
    return found.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """a and root (smallest member) of everything that occurs in edges (a, b), by alternating stars.

    Each round writes its edges to the shared folder, so a lost executor costs no earlier round.
    """
    edges = stored(edges.where("a <> b").distinct())
    state = None
    for _ in range(most_rounds):
        # large star: larger neighbours move to the smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        edges = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: smaller neighbours, and the node itself, move to the smallest
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if new == state:
            return edges.select("a", F.col("b").alias("root"))
        state = new
    raise RuntimeError("components did not settle")


def _classes(docs: DataFrame) -> DataFrame:
    """fp and component_id of every fingerprint of docs (doc_id, fp)."""
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    members = components(links(nodes))
    found = members.join(nodes.withColumnRenamed("fp", "a"), "a", "right")
    found = stored(found.select(F.col("a").alias("fp"), "rep", F.coalesce("root", "a").alias("root")))
    least = stored(found.groupBy("root").agg(F.min("rep").alias("component_id")))
    return stored(found.join(least, "root").select("fp", "component_id"))


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of df (doc_id, text)."""
    docs = stored(fingerprints(df.select("doc_id", "text")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return docs.join(_classes(docs), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(df: DataFrame) -> DataFrame:
    """The rows of df whose doc_id is the smallest of their class, with all their columns.

    A row that repeats another's doc_id and text is the same document: both stay or go. Rows without doc_id stay.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    docs = stored(fingerprints(df.select("doc_id", key.alias("key"), "text")))
    later = docs.join(_classes(docs), "fp").where("doc_id > component_id")
    later = stored(later.select("doc_id", "key"))
    rows = wrapped(df).withColumn("own", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = (F.col("row.doc_id") == F.col("doc_id")) & (F.col("own") == F.col("key"))
    return unwrapped(rows.join(later, same, "left_anti"), df.columns)
