"""Policies: checks on the driver, and what they do to texts."""

import pytest
from pyspark.sql import functions as F

from veilwork.functions import spans as S
from veilwork.operators import redaction
from veilwork.plans import policy


def field(**options):
    return {"fields": {"a": {"strategy": "regex", **options}}}


@pytest.mark.parametrize(
    "raw",
    [
        [], {"other": 1}, {"fields": [1]}, {"fields": {"": {"strategy": "regex"}}}, {"fields": {"a": 1}}, {"fields": {"a": {}}},
        {"fields": {"a": {"strategy": "hips"}}}, field(unknown=1), field(format=1), field(format="x" * 4097), field(entity_types="EMAIL"),
        field(entity_types=["x"] * 129), field(entity_types=["x" * 129]), field(entity_types=[""]), field(multi_pass=0), field(multi_pass=4),
        field(multi_pass=True), field(length=65), field(length=False), {"name": 3}, {"version": "v" * 4097},
        {"fields": {"x" * 129: {"strategy": "regex"}}}, {"fields": {str(i): {"strategy": "regex"} for i in range(129)}},
    ],
)
def test_bad_policies(raw):
    with pytest.raises(ValueError):
        policy.parse(raw)


def test_good_policies(tmp_path):
    assert policy.parse({}) == policy.Policy() and policy.parse({"fields": None}).fields == {}
    (tmp_path / "b.yaml").write_text("name: two\nfields:\n  x:\n    strategy: mask\n")
    (tmp_path / "a.yaml").write_text("name: one\n")
    assert [p.name for p in policy.load_all(str(tmp_path))] == ["one", "two"] and policy.load_all(str(tmp_path / "no")) == []
    with pytest.raises(FileNotFoundError):
        policy.load(str(tmp_path / "c.yaml"))
    assert policy.resolve(None, None) is policy.DEFAULT and policy.resolve(None, []) is None
    with pytest.raises(ValueError):
        policy.resolve({}, [])


def test_configured_default(tmp_path):
    (tmp_path / "good.yaml").write_text("name: good\nversion: '2'\n")
    (tmp_path / "bad.yaml").write_text("other: 1\n")
    assert policy.configured(None, "good") is None and policy.configured(str(tmp_path), None) is None
    good = policy.configured(str(tmp_path), "good")
    assert policy.version_of(policy.resolve(None, None, good)) == "2" and policy.version_of(policy.resolve(None, ["EMAIL"], good)) == "default"
    for name in ("bad", "missing"):
        with pytest.raises(policy.PolicyUnavailable):
            policy.configured(str(tmp_path), name)


def one(spark, text, raw, detectors=None):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = policy.redact(df, policy.parse(raw), detectors=detectors).first()
    return r["redacted"], [(s["start"], s["end"], s["type"]) for s in r["spans"]], r["relex_map"]


def test_default_policy(spark):
    df = spark.createDataFrame([(1, "Email alice@example.com")], "doc_id long, text string")
    r = policy.redact(df, policy.DEFAULT).first()
    assert r["redacted"] == "Email [EMAIL_0000]" and r["relex_map"] == {"alice@example.com": "[EMAIL_0000]"}


def test_fields_see_each_others_texts_and_report_original_places(spark):
    first = lambda text, _: _named(text, "Alice", "A")
    second = lambda text, _: _named(text, "Smith", "B")
    raw = {"fields": {"x": {"strategy": "autoDeID", "format": "[X]", "detector": "first"}, "y": {"strategy": "autoDeID", "format": "<Y>", "detector": "second"}}}
    assert one(spark, "Alice Smith", raw, {"first": first, "second": second})[:2] == ("[X] <Y>", [(0, 5, "A"), (6, 11, "B")])
    with pytest.raises(ValueError):
        one(spark, "x", raw)


def _named(text, word, kind):
    return F.transform(S.matches(text, word), lambda m: F.struct(m["start"], m["end"], F.lit(kind), F.lit(1.0)).cast(S.SPAN))


def test_a_hit_inside_a_placeholder_maps_to_its_start(spark):
    raw = {"fields": {"x": {"strategy": "regex", "entity_types": ["EMAIL"], "format": "1.2.3.4"}, "y": {"strategy": "regex", "entity_types": ["IPV4"], "format": "[IP]"}}}
    assert one(spark, "to a@b.example", raw) == ("to [IP]", [(3, 14, "EMAIL"), (3, 4, "IP_ADDRESS")], {})


def test_mask_and_hash_change_nothing(spark):
    assert one(spark, "a@b.example", {"fields": {"m": {"strategy": "mask"}, "h": {"strategy": "hash"}, "p": {"strategy": "passThrough"}}}) == ("a@b.example", [], {})


def test_cards(spark):
    text = "Card 4532015112830366."
    assert one(spark, text, {"fields": policy.MINIMAL.fields})[0] == "Card [CC-0366]."
    assert one(spark, text, {"fields": policy.DEFAULT.fields})[0] == "Card [CREDIT_CARD_0000]."


def test_staged_pipeline(spark):
    rows = [(1, "mail a@b.example at noon", False), (2, "nothing at all", True), (3, "a@b.example at", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    done = {r["doc_id"]: r for r in redaction.staged(df, "text", _named(F.col("text"), r"\bat\b", "WORD"), F.col("out")).collect()}
    assert done[1]["redacted"] == "mail [EMAIL_0001] [WORD_0001] noon" and not done[1]["used_fallback"]
    assert done[2]["status"] == "unavailable" and done[2]["redacted"] is None
    assert done[3]["redacted"] == "[EMAIL_0001] at" and done[3]["fallback"] == [] and len(done[3]["fused"]) == 1
    with pytest.raises(Exception, match="model stage unavailable"):
        redaction.staged(df, "text", S.empty(), F.col("out"), fail=True).select("redacted").collect()
