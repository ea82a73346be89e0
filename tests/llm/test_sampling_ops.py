"""Licence scans, periodic runs and importance resampling against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from veilwork.llm import importance, license_scan, periods
from veilwork.llm.queries import ORACLES, QUERIES


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def word_lists():
    rng = random.Random(5)
    out = [[], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 500, (["x"] * 7 + ["y"]) * 40, fibonacci(500), ["a", "b", "c"] * 4, ["é", "ü"] * 6]
    for _ in range(150):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 8, 100]))) for _ in range(rng.choice([5, 12, 30, 100, 250]))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 2))
            for i in range(a, min(len(words), a + rng.randrange(len(words)))):
                words[i] = words[a + (i - a) % p]
        out.append(words)
    return out


@pytest.mark.parametrize("searched", [1 << 16, 3])
def test_runs_are_all_found(monkeypatch, searched):
    monkeypatch.setattr(periods, "SEARCHED", searched)
    docs = word_lists()
    found = periods.collapsed([[w.encode() for w in words] for words in docs])
    for words, (runs, left) in zip(docs, found):
        expected, kept = brute.periodic_runs(words)
        assert (runs, left.decode()) == (expected, " ".join(kept))


def test_a_long_text_of_one_word_takes_time_in_proportion():
    [(runs, left)] = periods.collapsed([[b"x"] * 200_000])
    assert runs == [(0, 200_000, 1)] and left == b"x"


def test_periods_of_dirty_rows(spark):
    same = "one two three " * 5
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 1), (4, same, 1), (4, same, 2), (None, same, 3), (5, "a\x1cb\x85 " * 12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = {(r["doc_id"], r["n_words"]): r for r in periods.find(df).collect()}
    assert len(out) == 6 and out[None, 15]["collapsed"] == "one two three"
    assert [tuple(r) for r in out[4, 15]["runs"]] == [(0, 15, 3)] and out[1, 0]["runs"] == [] and out[5, 12]["collapsed"] == "a\x1cb\x85"
    assert periods.find(df.limit(0)).collect() == []
    told = {r["doc_id"]: r for r in periods.digests(periods.find(df)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert told[1].asDict() == {"doc_id": 1, "n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None, "runs_sha256": nothing, "collapsed_sha256": nothing}
    assert told[4]["exponent_milli"] == 5000 and told[4]["runs_sha256"] == hashlib.sha256(b"0,15,3\n").hexdigest()


def test_planted_periods(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"].encode().split() for r in docs.collect()}
    made = {r["doc_id"]: r["text"].encode().split() for r in periods.planted(docs).collect()}
    assert made == {i: brute.made_periodic(i, w) for i, w in before.items()} and made != before
    odd = spark.createDataFrame([(None, "a b"), (1, None), (20, "")], "doc_id long, text string")
    assert {tuple(r) for r in periods.planted(odd).collect()} == {(None, "a b"), (1, None), (20, "")}


TEXTS = ["Hello World", "", None, "abc1 ABC1", "déf é Ü-x", "z" * 5000 + " a", "  ", "KK x\x00y", "über", "K k", "a" * 70 + " " + "a" * 71] + [f"w{i}" for i in range(20)]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("slice_bytes", [1 << 20, 8])
def test_features(monkeypatch, longest, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    import zlib

    for column, texts in ((pa.array(TEXTS), TEXTS), (pa.array(TEXTS)[3:9], TEXTS[3:9]), (pa.array([], pa.string()), [])):
        buckets, words = [], []
        for values, ends in importance.slices(column):
            own, owner, n = importance.features(values, ends, importance.Plan(longest=longest))
            buckets += [sorted(own[owner == i].tolist()) for i in range(len(ends))]
            words += n.tolist()
        expected = []
        for t in texts:
            w = brute.lowered_words(t)
            expected.append(sorted(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)))
        assert buckets == expected and words == [len(brute.lowered_words(t)) for t in texts]


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_equals_brute_force(spark, sf_dir, longest):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plan = importance.Plan(longest=longest)
    out = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.drawn(docs, target, plan).collect()}
    expected = brute.importance([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], longest=longest)
    assert out == expected and sum(v[3] is not None for v in out.values()) > 10


def test_draw_of_dirty_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i, text, "x") for i in range(20)] + [(3, text, "y"), (None, text, None), (40, None, "z"), (41, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    out = importance.drawn(df, target).collect()
    assert len(out) == len(rows) and sorted(r["rank"] for r in out if r["rank"]) == [1, 2]
    plan = importance.Plan(percent=100)
    every = importance.drawn(df, target, plan).collect()
    assert sorted(r["rank"] for r in every if r["rank"]) == list(range(1, 23))
    assert len({r["score"] for r in every if r["doc_id"] == 3}) == 1
    kept = importance.resample(df, target, plan)
    assert kept.columns == df.columns and kept.count() == 22
    assert importance.drawn(df.limit(0), target).collect() == []
    assert {r["weight"] for r in importance.drawn(df, target.limit(0)).collect() if r["doc_id"] in (40, 41)} == {0}
    assert np.all(importance.gains(df.limit(0), target.limit(0), plan) == 0)


# --- licence scans ---------------------------------------------------------------------------------------------------

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
LICENSE_ROWS = [
    (1, None, 0, None, None, "", "", 0.0),
    (2, "", 0, None, None, "", "", 0.0),
    (3, "Released UNDER the MIT License.", 1, 1, 1, "mit", "mit", 1.0),
    (4, "under the mit licenses; under mit license; xunder the mit license", 0, None, None, "", "", 0.0),
    (5, "under the MIT-license\nunder--the (mit) License, Apache License version 2", 3, 0, 8, "apache-2,mit", "apache-2,mit", 1.0),
    (6, f"x {NOTICE} y", 0, None, None, "", "mit", 1.0),
    (7, NOTICE.replace("any person", "any good old person"), 0, None, None, "", "mit", 1.0),
    (8, NOTICE.replace("free of charge", "for a fee"), 0, None, None, "", "", 0.0),
    (9, f"{BSD} ... {NOTICE}", 0, None, None, "", "bsd,mit", 1.0),
    (10, "mit " * 20_000, 0, None, None, "", "", 0.0),
    (11, "under the mit license " * 500, 500, 0, 1996, "mit", "mit", 1.0),
    (12, "under the mit lıcense apache lKcense version 2 éunder the mit license", 0, None, None, "", "", 0.0),
    (13, "Licensed under CC BY-NC 4.0. cc by nc", 1, 2, 2, "cc-by-nc", "cc-by-nc", 1.0),
    (13, "Licensed under CC BY-NC 4.0. cc by nc", 1, 2, 2, "cc-by-nc", "cc-by-nc", 1.0),
    (None, "cc by nc cc by nc", 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0),
]


def test_license_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t, *_ in LICENSE_ROWS], "doc_id long, text string, words string").repartition(3)
    out = license_scan.scan(df)
    shown = ("doc_id", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = sorted((tuple(r[c] for c in shown) for r in out.collect()), key=str)
    assert got == sorted(((i, *rest) for i, _, *rest in LICENSE_ROWS), key=str)
    assert {r["doc_id"]: r["n_words"] for r in out.collect()} == {i: len(brute.lowered_words(t)) for i, t, *_ in LICENSE_ROWS}
    spans = {r["doc_id"]: [(g["label"], g["start"], g["end"]) for g in r["found"]] for r in out.collect()}
    assert spans[6] == [("mit", 0, 22)] and spans[1] == []
    assert license_scan.scan(df.limit(0)).collect() == []


def test_own_templates_and_overlapping_phrases(spark):
    own = (license_scan.Template("house", "Only for use inside of the house", ("inside of the house",)),)
    df = spark.createDataFrame([(1, "only for use INSIDE of the house; go go go go")], "doc_id long, text string")
    [r] = license_scan.scan(df, own, {"go go": "go"}).collect()
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"], r["base_labels"]) == (3, 7, 9, "go,house", "go")


def test_license_plan_is_native(spark, sf_dir):
    plan = QUERIES["op11_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_periodic_runs", "op13_importance_draw"])
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(theirs, key=str)
