"""Sweeps over intervals against pairs of all spans, and in time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilwork.operators import intervals

DDL = "doc_id long, start int, `end` int"


def cases(rng, n, empty=True):
    out = set()
    for _ in range(n):
        a = rng.randrange(-3, 40)
        out.add((rng.choice([1, 2, 3]), a, a + rng.randrange(0 if empty else 1, 9)))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_sweeps_equal_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = cases(rng, 25), cases(rng, 12)
    left, right = spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL)
    lengths = spark.createDataFrame([(i, 38) for i in (1, 2, 3)], "doc_id long, length int")
    meets = lambda s: any(o[0] == s[0] and o[1] < s[2] and s[1] < o[2] for o in b)
    assert rows(intervals.touched(left, right)) == [s for s in a if meets(s)]
    assert rows(intervals.untouched(left, right)) == [s for s in a if not meets(s)]
    runs, others = intervals.union(left, lengths), intervals.union(right, lengths)
    chars = lambda spans, i: {c for d, x, y in spans if d == i for c in range(max(0, x), min(38, y))}
    found = rows(intervals.difference(runs, others))
    for i in (1, 2, 3):
        assert chars(found, i) == chars(a, i) - chars(b, i)
        own = [s for s in found if s[0] == i]
        assert all(x[2] < y[1] for x, y in zip(own, own[1:]))
    # borders of others that hold nothing part no piece
    raw = rows(intervals.difference(runs, right.where("start = `end`")))
    assert raw == rows(runs)
    named = left.withColumn("span_id", F.concat_ws("-", "start", "end"))
    for r in intervals.coverage(named, others).collect():
        own = range(r["start"], r["end"])
        expected = len(chars(b, r["doc_id"]) & set(own)) / len(own) if len(own) else 0.0
        assert r["coverage"] == pytest.approx(expected)
    assert intervals.coverage(named, others).count() == len(a)


def test_nothing_on_either_side(spark):
    some, none = spark.createDataFrame([(1, 0, 5), (None, 1, 2), (1, None, 4)], DDL), spark.createDataFrame([], DDL)
    assert intervals.touched(some, none).count() == 0 and intervals.untouched(some, none).count() == 3
    assert rows(intervals.difference(some.where("doc_id = 1 and start = 0"), none)) == [(1, 0, 5)] and intervals.difference(none, some).count() == 0
    assert intervals.touched(none, some).count() == 0
    named = some.withColumn("span_id", F.lit("x"))
    assert {r["coverage"] for r in intervals.coverage(named.where("doc_id = 1 and start = 0"), none).collect()} == {0.0}


def test_a_text_with_very_many_spans(spark):
    n = 100_000
    many = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 5).cast("int").alias("end"))
    few = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 2).cast("int").alias("end"))
    began = time.time()
    assert intervals.touched(many, few).count() > n // 2
    assert intervals.coverage(many.withColumn("span_id", F.col("start").cast("string")), few).where("coverage > 0").count() > n // 2
    assert intervals.difference(few, many).count() > n // 3
    assert time.time() - began < 40
