"""The pipeline, stage by stage, against brute force."""

import hashlib
import os
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from veilwork.llm import common, quality


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_quality_stage(stages, spark, sf_dir):
    before, after = rows(stages[0]), rows(stages[1])
    failed = {r[0] for r in before if brute.base_quality(r[1])[5]}
    assert not failed & {r[0] for r in after} and set(after) <= set(before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r[0] for r in after}
    clean = [r[0] for r in before if labels.get(r[0]) == 1 and r[0] not in failed]
    assert len([d for d in clean if d in kept]) >= 0.98 * len(clean)
    fitted = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept == {r["doc_id"] for r in quality.judge(stages[0], fitted).where("kept").collect()}


def test_near_dedup_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    classes = brute.components({r[0]: brute.simhash(r[1]) for r in before})
    assert sorted(after) == sorted(r for r in before if classes[r[0]] == r[0])


def test_secrets_stage(stages):
    before, after = {r[0]: r for r in rows(stages[2])}, {r[0]: r for r in rows(stages[3])}
    assert before.keys() == after.keys()
    for i, r in before.items():
        found = brute.base_secrets(r[1])
        if any(found[:3]):
            assert after[i][1] != r[1] and not any(brute.base_secrets(after[i][1])[1:3])
        parts = [re.escape(p) for p in after[i][1].split("[SECRET]")]
        assert re.fullmatch(".+?".join(parts), r[1], re.S)
        assert after[i][4] == len(after[i][1])


def test_mixing_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    drawn = Counter(after)
    assert set(drawn) == set(before) and max(drawn.values()) <= 2
    tokens, got = Counter(), Counter()
    for r in before:
        tokens[r[3]] += len(r[1].split())
    for r in after:
        got[r[3]] += len(r[1].split())
    assert max(got[s] / tokens[s] for s in tokens) <= 2 and min(got[s] / tokens[s] for s in tokens) == 1


def test_token_stage_and_run(stages, spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows(stages[4]):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = hashlib.sha256((r[1] or "").encode()).hexdigest()
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text, tuple(ids)] += 1
    shaped = lambda df: Counter((*r[:4], tuple(r[4])) for r in rows(df))
    assert shaped(stages[5]) == want
    assert shaped(corpus_pipeline.run(spark, sf_dir)) == want


def test_dirty_and_empty_rows(spark, sf_dir):
    text = "Many plain words stand here so that the rules have nothing to say against it at all."
    dirty = [(1, None, None, None, None), (None, text, "en", None, 5), (2, text, None, "a", None), (2, text, None, "a", None)]
    dirty += [(3, text, "en", "b", 1), (4, "w1 " + " ".join(f"x{i}" for i in range(30_000)), "en", "b", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for some, ids in ((dirty, {None, 2, 4}), ([], set())):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert {r["doc_id"] for r in docs.collect()} == ids


INNER = ("row", "text_", "own", "key", "fp", "_fp", "_doc_id", "_own_fp", "_tokens", "_source", "_block", "_base", "_found", "room", "whole", "full_epochs", "a.b")


@pytest.mark.parametrize("names", [INNER[k : k + 3] for k in range(0, len(INNER), 3)])
def test_columns_with_any_names_pass_through(spark, names):
    text = "Many plain words number {} stand here so that the rules have nothing to say against it at all, token = abcdefghijkl."
    rows = [(i, text.format(i % 4), "en", "ab"[i % 2], 5, *[i + k for k in range(len(names))]) for i in range(8)]
    more = ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        found = stage(spark, docs, "")
        assert found.schema.simpleString() == docs.schema.simpleString(), name
        assert {(r[0], *r[5:]) for r in found.collect()} <= {(r[0], *r[5:]) for r in rows}, name
        assert name == "near_dedup" or {r[0] for r in found.collect()} == set(range(8)), name


def test_quality_stage_keeps_any_columns(spark):
    rows = [(1, "Many plain words stand here so that the rules have nothing to say against it.", 7, [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, `a.b` array<int>")
    assert [tuple(r) for r in quality.keep(docs, quality.Chain()).collect()] == rows


def test_repeated_rows_are_one_document(spark, sf_dir):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.keep_first(spark, docs, sf_dir).collect()
    assert sorted(r[0] or 0 for r in found) == [0, 1, 1]


def test_stored_tables_are_cleared(spark):
    common.stored(spark.range(3)).count()
    folder = common.session_folder(spark)
    assert os.listdir(folder.removeprefix("file:"))
    common.clear(spark)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_a_shared_folder_is_asked_for_off_this_machine():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
