"""Operations, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests import plain
from veilwork.operators import operations
from veilwork.sources import corpus, tables
from veilwork.streaming import stateful


def test_job_states(spark):
    rows = [("a", i, e) for i, e in enumerate(["submit", "claim", "done", "cancel", "failed"])] + [("b", 0, "done")]
    df = spark.createDataFrame(rows, "job_id string, seq int, event string")
    assert {tuple(r) for r in operations.job_states(df).collect()} == {("a", "done", 3), ("b", "none", 0)}


def test_request_ids(spark):
    df = spark.createDataFrame([("ok-1",), ("a b",), ("x" * 129,), ("",), (None,), ("line\n",)], "given string")
    assert [r[0] for r in df.select(operations.request_id(F.col("given"), F.lit("new"))).collect()] == ["ok-1"] + ["new"] * 5


def test_corpus_round_trip(spark, tmp_path):
    path = tmp_path / "docs.jsonl"
    path.write_text('{"id": "a", "text": "x\\ny", "category": "emails"}\n\n{"id": "b", "text": "", "category": "code", "genre": "g", "source": "s"}\n')
    docs = corpus.read_documents(spark, str(path))
    assert [tuple(r) for r in docs.orderBy("id").collect()] == [("a", "x\ny", "emails", "", "synthetic", "unstructured"), ("b", "", "code", "g", "s", "structured")]
    corpus.write_documents(docs, str(tmp_path / "out"))
    assert corpus.read_documents(spark, str(tmp_path / "out")).count() == 2
    path.write_text('{"id": "a", "text": "x", "category": "novels"}\n')
    with pytest.raises(Exception, match="unknown category"):
        corpus.read_documents(spark, str(path)).collect()


def test_annotations(spark, tmp_path):
    path = tmp_path / "ann.jsonl"
    spans = [{"start": 0, "end": 7, "category": "mandatory"}, {"start": 0, "end": 3, "category": "mandatory"}]
    path.write_text(json.dumps({"doc_id": "a", "spans": spans, "text": "abc\ndef"}) + "\n")
    r = corpus.read_annotations(spark, str(path)).first()
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(0, 3), (4, 7)]
    corpus.write_annotations(corpus.read_annotations(spark, str(path)), str(tmp_path / "out"))
    docs = spark.createDataFrame([("a", "abc")], "id string, text string")
    with pytest.raises(Exception, match="span out of range"):
        corpus.read_annotations(spark, str(path), docs).collect()


def test_predictions_and_fixtures(spark, tmp_path):
    (tmp_path / "p").write_text('{"doc_id": "a", "predictions": [{"start": 1, "end": 2}]}\n')
    (tmp_path / "f").write_text('{"text": "t", "entities": []}\n')
    assert corpus.read_predictions(spark, str(tmp_path / "p")).first()["predictions"][0]["end"] == 2
    assert corpus.read_fixture(spark, str(tmp_path / "f")).count() == 1


def test_tree_digest(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x").write_bytes(b"1")
    (tmp_path / "d" / "e" / "y").write_bytes(b"2")
    first = tables.tree_digest(spark, f"file:{tmp_path}/d").first()
    assert first["n_files"] == 2
    (tmp_path / "d" / "x").write_bytes(b"3")
    assert tables.tree_digest(spark, f"file:{tmp_path}/d").first()["digest"] != first["digest"]


def test_audit_sink(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-01T10:00:00Z"), ("2", "bad")], "request_id string, ts string")
    tables.write_audit(df, str(tmp_path / "audit"))
    days = {r["day"] for r in spark.read.option("prefersDecimal", False).json(str(tmp_path / "audit")).select(F.col("day").cast("string")).distinct().collect()}
    assert days == {"2024-01-01", "unknown"}


def stream(spark, tmp_path, rows, schema):
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    return spark.readStream.schema(schema).parquet(src)


def drained(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_rate_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit("k").alias("key"))
    batch = operations.fixed_window(events, "key", "ts", "event_id", 2, 3600).groupBy("window_start").agg(F.count_if(~F.col("accepted")).alias("n"))
    want = {r["window_start"]: r["n"] for r in batch.collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "src"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "src"))
    found = drained(spark, stateful.rate_counts(live, "key", "ts", 2, 3600), "rates", "update")
    assert {int(r["window_start"].timestamp()): r["rejected"] for r in found} == want


def test_idempotent_stream(spark, tmp_path):
    from datetime import datetime

    rows = [("a", datetime(2024, 1, 1, 0, 0, 1), 1), ("a", datetime(2024, 1, 1, 0, 0, 2), 2), ("b", datetime(2024, 1, 1, 0, 0, 3), 3)]
    df = stateful.idempotent(stream(spark, tmp_path, rows, "key string, ts timestamp, seq int"), "ts")
    assert sorted(r["key"] for r in drained(spark, df, "firsts", "append")) == ["a", "b"]


def test_job_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [("a", 0, "submit"), ("a", 1, "claim"), ("a", 2, "done"), ("a", 3, "failed"), ("b", 0, "submit"), ("b", 1, "cancel"), ("c", 0, "claim")]
    timed = [(*r, at + timedelta(seconds=i)) for i, r in enumerate(rows)]
    live = stream(spark, tmp_path, timed, "job_id string, seq long, event string, ts timestamp")
    found = {r["job_id"]: r["status"] for r in drained(spark, stateful.job_lives(live), "jobs", "update")}
    batch = operations.job_states(spark.createDataFrame(rows, "job_id string, seq long, event string")).collect()
    assert found == {r["job_id"]: r["status"] for r in batch}


def test_worker_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [("w", at + timedelta(seconds=s)) for s in (0, 5, 10, 40, 1000)]
    live = stateful.live_workers(stream(spark, tmp_path, rows, "worker string, ts timestamp"), "ts")
    assert sorted(r["beats"] for r in drained(spark, live, "workers", "complete")) == [1, 1, 3]


def test_redact_and_audit_stream(spark, tmp_path):
    live = stream(spark, tmp_path, [(1, "a@b.example"), (2, "none")], "doc_id long, text string")
    stateful.redact_and_audit(live, str(tmp_path / "out"), str(tmp_path / "audit"), str(tmp_path / "check")).awaitTermination(120)
    out = {r["doc_id"]: r["redacted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: "[REDACTED]", 2: "none"} and spark.read.parquet(str(tmp_path / "audit")).first()["type"] == "EMAIL"
    assert not any(plain.detect(t) for t in out.values())
