"""Operators that compare documents with each other, against brute force."""

import math
import os
import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from veilwork.llm import gru_lm, mixing, simhash, suffix_dedup
from veilwork.llm.queries import QUERIES

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def random_words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for level in range(4):
        masks = simhash.masks(level)
        assert len(set(masks)) == 2 ** (simhash.RADIUS + 1) - 1
        for _ in range(4000):
            bits = rng.sample(range(64), rng.randrange(1, simhash.RADIUS + 1))
            assert any(not any(m >> b & 1 for b in bits) for m in masks)
    assert all(any(not (m >> a & 1 or m >> b & 1) for m in simhash.masks()) for a, b in combinations(range(64), 2))


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "a b c", "A b C d", "a b c d e", "é É\x1cx\x85y z", *(random_words(rng, n) for n in (3, 4, 5, 50, 300))]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == brute.simhash(t)


@pytest.mark.parametrize("direct", [1024, 8])
def test_connect(direct, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(direct)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 8)))
            fps.add(base)
    fps = sorted(fps)
    want = brute.components(dict(enumerate(fps)))
    assert simhash.connect(np.array(fps, np.uint64)).tolist() == [want[i] for i in range(len(fps))]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_components_of_chains(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    fps, x = {}, rng.getrandbits(63)
    for i in range(60):  # a long chain, and strangers
        x ^= sum(1 << b for b in rng.sample(range(63), 4))
        fps[i * 2] = x
        fps[i * 2 + 1] = rng.getrandbits(63)
    nodes = spark.createDataFrame([(v,) for v in set(fps.values())], "fp long")
    found = {r["a"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    classes = lambda of: {frozenset(d for d in fps if of(d) == c) for c in {of(d) for d in fps}}
    want = brute.components(fps)
    assert classes(lambda d: found.get(fps[d], fps[d])) == classes(want.get)


def test_near_duplicates_of_dirty_rows(spark):
    rng = random.Random(5)
    base = random_words(rng, 400).split()
    rows = [(7, None), (3, ""), (9, " \n")]
    for i in range(20, 40):
        words = list(base)
        words[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(50, random_words(rng, 80)), (50, random_words(rng, 80)), (51, "x" * 100_000), (None, " ".join(base)), (60, "UPPER case Text of words"), (61, "upper case text of words")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    prints = {(r["doc_id"], r["fingerprint"]) for r in found}
    assert prints == {(i, f"{brute.simhash(t):016x}") for i, t in rows}
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert of[7] == of[3] == of[9] == 3 and of[61] == 60 and of[None] == 20
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_of_the_corpus(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: brute.simhash(t) for d, t in docs.items()}
    want = {d: (f"{fps[d]:016x}", c) for d, c in brute.components(fps).items()}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_covering_simhash"](spark, sf_dir).collect()}
    assert found == want


def repeating_documents(rng, n):
    """Documents that share passages, borders of passages, lines, and whole texts."""
    passages = [random_words(rng, rng.randrange(8, 60)) for _ in range(12)]
    docs = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else random_words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 7))]
        docs.append(rng.choice((" ", "\n")).join(parts))
    docs += rng.sample(docs, n // 5)
    docs += [p[: rng.randrange(40, len(p))] for p in passages if len(p) > 45]
    return docs


def held_against_brute(df, rows, **options):
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.deduplicate(df, **options).collect()}
    assert found == brute.removed({i: (t or "").encode() for i, t in rows})


@pytest.mark.parametrize("chunk, hot, buckets", [(10**6, 2000, 3), (3000, 2000, 5), (2000, 3, 4), (500, 0, 2)])
def test_suffix_dedup(spark, monkeypatch, chunk, hot, buckets):
    rng = random.Random(chunk + hot)
    texts = repeating_documents(rng, 60) + [None, "", "short", "y" * 49, "y" * 50, "y" * 51, "z" * 5000, "z" * 300, "é" * 40, "日本" * 30, "x" + "é" * 40]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, chunk binary").repartition(3)
    # workers import the module anew: the settings travel with the functions
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    held_against_brute(df, rows, buckets=buckets)


def test_suffix_dedup_without_ids_and_with_repeated_rows(spark):
    rng = random.Random(6)
    passage, other = random_words(rng, 40), random_words(rng, 40)
    rows = [(None, passage), (4, passage), (4, passage), (4, other + passage), (9, other), (None, other + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.deduplicate(df, with_text=True).collect()
    left = sorted((r["doc_id"] or 0, r["n_removed"], bytes(r["kept"]).decode()) for r in found)
    assert left == sorted([(4, 0, passage), (4, 0, passage), (4, 0, other + passage), (9, len(other), ""), (0, len(passage), ""), (0, len(other), "!")])
    assert suffix_dedup.deduplicate(df.where("false")).count() == 0


def test_suffix_dedup_of_the_corpus(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_merged_suffixes"](spark, sf_dir).collect()}
    assert found == brute.removed({i: (t or "").encode() for i, t in rows})


def test_front_coding_and_loser_tree():
    rng = random.Random(3)
    for _ in range(150):
        runs = []
        for _ in range(rng.randrange(1, 9)):
            keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))})
            n = len(keys)
            decoded = suffix_dedup.front_decode(suffix_dedup.front_code(suffix_dedup.Run(keys, [1] * n, [2] * n, [3] * n)))
            assert decoded[0] == keys
            runs.append(decoded[:2])
        out = list(suffix_dedup.merged(runs))
        keys = [runs[r][0][i] for r, i, _ in out]
        assert keys == sorted(k for r in runs for k in r[0])
        for before, key, (_, _, shared) in zip(keys, keys[1:], out[1:]):
            assert shared == len(os.path.commonprefix([before, key]))


def test_loser_tree_reads_no_known_prefix():
    """Two runs whose keys share long prefixes: the bytes compared stay far below those of whole keys."""
    prefix = b"p" * 10_000
    runs = [[prefix + bytes([2 * i + k]) for i in range(60)] for k in (0, 1)]
    common = [[0] + [10_000] * 59 for _ in runs]

    class Watched(bytes):
        read = 0

        def __getitem__(self, at):
            got = bytes.__getitem__(self, at)
            Watched.read += len(got) if isinstance(got, bytes) else 1
            return got

    list(suffix_dedup.merged([([Watched(k) for k in r], c) for r, c in zip(runs, common)]))
    assert Watched.read < 10 * len(prefix)


def test_anchors_are_the_same_wherever_a_string_stands():
    rng = random.Random(8)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(300))) for _ in range(6)]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        s = suffix_dedup.segments(data, sizes)
        offsets, seen = {}, 0
        for p, left, right in zip(s.place.tolist(), s.left.tolist(), s.right.tolist()):
            for start in range(p - left, p + right - suffix_dedup.SIZE + 1):
                string = data[start : start + suffix_dedup.SIZE].tobytes()
                assert offsets.setdefault(string, p - start) == p - start
                seen += 1
        assert seen == sum(max(0, len(t) - suffix_dedup.SIZE + 1) for t in texts)


def mixed(rows, spark, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, block int")
    return df, mixing.draws(df, mixing.Target(**options)).collect()


def test_mix_repetition_limit(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else f"small{i % 7}", random_words(rng, rng.randrange(1, 60)), 0) for i in range(900)]
    df, found = mixed(rows, spark, repetition=2.0)
    words = {r[0]: len(r[2].split()) for r in rows}
    tokens, drawn = Counter(), Counter()
    for i, s, _, _ in rows:
        tokens[s] += words[i]
    for r in found:
        drawn[r["source"]] += r["n_tokens"]
        assert r["n_tokens"] == words[r["row"]["doc_id"]]
    assert {r["row"]["doc_id"] for r in found} == set(words)  # nothing is lost
    assert max(Counter(r["row"]["doc_id"] for r in found).values()) <= 2
    ratio = {s: drawn[s] / tokens[s] for s in tokens}
    assert ratio["big"] == 1.0 and 1.8 < max(ratio.values()) <= 2.0
    # weights are shares to one power, and what is drawn follows them
    weight = {r["source"]: r["weight"] for r in found}
    total = sum(tokens.values())
    power = {s: math.log(weight[s] / weight["big"]) / math.log(tokens[s] / tokens["big"]) for s in tokens if s != "big"}
    assert max(power.values()) - min(power.values()) < 1e-6 and 0 < min(power.values()) < 1
    for s in tokens:
        assert abs(drawn[s] / sum(drawn.values()) - weight[s]) < 0.01
    assert abs(sum(weight.values()) - 1) < 1e-9 and total


def test_mix_entropy_and_budget(spark):
    rng = random.Random(2)
    rows = [(i, "abcd"[min(3, i % 11)], random_words(rng, 20), 0) for i in range(600)]
    df, found = mixed(rows, spark, repetition=None, entropy=1.2, budget=6000)
    weight = {r["source"]: r["weight"] for r in found}
    assert abs(-sum(w * math.log(w) for w in weight.values()) - 1.2) < 1e-4
    drawn = Counter()
    for r in found:
        drawn[r["source"]] += r["n_tokens"]
    assert sum(drawn.values()) <= 6000 and all(6000 * w - 21 <= drawn[s] <= 6000 * w + 1 for s, w in weight.items())


def test_mix_of_dirty_rows(spark):
    rows = [(1, None, None, 0), (None, "a", "x y", 0), (2, "a", "", 0), (2, "a", "", 0), (3, "b", "w " * 50_000, 0), (4, "", "one", 0), (4, "", "one", 0)]
    df, found = mixed(rows, spark)
    taken = Counter((r["row"]["doc_id"], r["row"]["source"]) for r in found)
    assert all(taken[(i, s)] >= n for (i, s), n in Counter((r[0], r[1]) for r in rows).items())
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.where("false")).count() == 0
    blank = df.where("doc_id = 2")
    assert mixing.mix(blank).count() == 2


@pytest.mark.parametrize("name", ["row", "copies", "epoch", "room", "whole", "full_epochs", "weight", "crossing", "last", "n_tokens", "block", "a.b"])
def test_mix_of_clashing_columns(spark, name):
    rows = [(i, "ab"[i % 5 == 0], "w " * (1 + i % 7), -i) for i in range(200)]
    df = spark.createDataFrame(rows, f"doc_id long, source string, text string, `{name}` int")
    found = mixing.mix(df)
    assert found.schema.simpleString() == df.schema.simpleString()
    assert set(map(tuple, found.collect())) == set(rows)


def test_mix_orders_rows_that_share_everything_but_text(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 1)  # a source is one block, which crosses the budget
    rows = [(1, "a", f"{c} {c} {c}", i) for i, c in enumerate("abcdefghij")] + [(2, "b", "w " * 300, 0)]
    seen = []
    for k in (1, 3, 7):
        df, found = mixed(rows, spark, repetition=None, budget=160)
        df = df.repartition(k)
        seen.append(Counter(map(tuple, mixing.mix(df, mixing.Target(repetition=None, budget=160)).collect())))
    assert seen[0] == seen[1] == seen[2] and sum(seen[0].values())


def test_mix_shuffles_no_text_but_of_crossing_blocks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.count("Aggregate") == 0


def test_mix_is_native(spark, sf_dir):
    plan = QUERIES["op2_temperature_mix"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = gru_lm.Network.start([50] * gru_lm.RARE, 1000)
    net = gru_lm.Network(*(a.astype(float) + rng.standard_normal(a.shape) * 0.1 for a in net.arrays()))
    x, y = rng.integers(0, gru_lm.RARE + 2, (5, 3)), rng.integers(0, gru_lm.RARE + 1, (5, 3))
    there = np.ones((5, 3), bool)
    there[4, 2] = False
    h = np.zeros((3, gru_lm.HIDDEN))
    grads = gru_lm.gradients(net, h, x, y, there)[0]
    for a, g in zip(net.arrays(), grads):
        for at in [np.unravel_index(i, a.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            old, losses = a[at], []
            for e in (1e-5, -1e-5):
                a[at] = old + e
                losses.append(gru_lm.gradients(net, h, x, y, there)[2])
            a[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 / there.sum() - g[at]) < 1e-6


def test_state_is_carried_and_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    net = gru_lm.Network.start(list(range(600, 0, -1)), 100)
    net = gru_lm.Network(*((a + rng.standard_normal(a.shape) * 0.3).astype(np.float32) for a in net.arrays()))
    docs = [rng.integers(0, gru_lm.RARE + 1, n) for n in (1, 2, 31, 32, 33, 200, 65)]
    whole = gru_lm.score(net, docs)
    for d, s in zip(docs, whole):
        h, total, before = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0, gru_lm.START
        for y in d:
            h = gru_lm._step(net, h, np.array([before]))
            every = gru_lm.log_likelihoods(net, np.repeat(h, gru_lm.RARE + 1, 0), np.arange(gru_lm.RARE + 1))
            assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-4
            total, before = total + every[y], y
        assert abs(total / math.log(10) - s) < 1e-3 * max(1, abs(s))


def test_scores_of_dirty_rows(spark, monkeypatch):
    rng = random.Random(5)
    lines = [random_words(rng, 12) for _ in range(20)]
    texts = {i: " ".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \t", 203: "q" * 100_000, 204: "ONE one İ É é\x1c"}
    monkeypatch.setattr(gru_lm, "KNOWN_WORDS", 150)
    df = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "doc_id long, text string, score double").repartition(3)
    want = brute.unigram_base(texts)
    rows = gru_lm.score_documents(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert gru_lm.score_documents(df.where("false")).count() == 0
    lone = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r["train_tokens"] for r in gru_lm.score_documents(lone).collect()] == [6, 6]


def test_numbering_holds_little_at_once(spark):
    """Texts of 8 MB whose words a worker does not know."""

    class Caught:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = gru_lm.numbered(Caught(), gru_lm.Vocabulary({"a": 3}, 3, 1))
    texts = [" ".join(f"w{k}-{i}" for i in range(20_000)) + " a a" for k in range(40)]
    batch = pa.RecordBatch.from_pydict({"row": list(range(40)), "doc_id": list(range(40)), "text": texts})
    tracemalloc.start()
    found = [(out.column("n_known").to_pylist(), out.column("n_tokens").to_pylist()) for out in run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [n for known, _ in found for n in known] == [2] * 40 and {n for _, sizes in found for n in sizes} == {20_003}
    assert peak < 100e6


def test_network_beats_the_base_on_held_out_documents(spark, sf_dir):
    rows = QUERIES["op10_gru_scores"](spark, sf_dir.replace("sf0.001", "sf0.01")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.97 * sum(r["base_score"] for r in rows) and len(rows) > 50
    better = sum(r["score"] > r["base_score"] for r in rows)
    assert better > 0.8 * len(rows)


def test_every_training_word_trains_once(spark):
    texts = {1: 1, 2: 64, 3: gru_lm.SEGMENT, 4: gru_lm.SEGMENT + 1, 5: 5000, None: 130}
    rows = [(i, False, np.arange(n, dtype="<u2").tobytes()) for i, n in texts.items()] + [(6, True, b"\0\0")]
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, numbers binary")
    found = gru_lm.segments(df, 3).collect()
    words = Counter()
    for r in found:
        own = np.frombuffer(r["numbers"], "<u2").tolist()
        words.update(own)
        before = int.from_bytes(r["before"], "little") if r["before"] else None
        assert before == (own[0] - 1 if own[0] else None) and len(own) <= gru_lm.SEGMENT
    assert words == Counter(w for n in texts.values() for w in range(n))
    assert {r["round"] for r in found} <= set(range(gru_lm.ROUNDS)) and {r["shard"] for r in found} <= {0, 1, 2}


def test_windows_carry_every_text_through_one_lane():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 900, n).astype("<u2") for n in (5, 1, 40, 17, 3, 16, 33)]
    got = {k: [] for k in range(len(texts))}
    for w in gru_lm.windows(texts, list(range(7)), 3, 16):
        assert len(w.text) <= 3
        w.after = w.h + 1
        for lane, k in enumerate(w.text.tolist()):
            on = w.there[:, lane]
            before = got[k][-1] if got[k] else k
            assert w.x[on, lane].tolist() == [before, *w.y[on, lane][:-1].tolist()] and (w.h[:, lane] == len(got[k]) // 16).all()
            got[k] += w.y[on, lane].tolist()
    assert got == {k: t.tolist() for k, t in enumerate(texts)}


def test_scores_do_not_depend_on_the_layout(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD_WORDS", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [{r["doc_id"]: r["score"] for r in gru_lm.score_documents(docs.repartition(n)).collect()} for n in (1, 4, 16)]
    for other in seen[1:]:
        assert max(abs(other[d] / s - 1) for d, s in seen[0].items()) < 1e-6


def test_blobs_travel_together():
    """Rows grow with the product of chunks and buckets: small ones share a batch and a compressor, large ones do not pile up."""
    small = [(b, 7, bytes([b])) for b in range(200)]
    batches = list(suffix_dedup._batches(iter(small)))
    assert len(batches) == 1 and [tuple(r.values()) for r in batches[0].to_pylist()] == small
    large = [(b, 7, bytes(suffix_dedup.BATCH_BYTES // 2)) for b in range(5)]
    assert [b.num_rows for b in suffix_dedup._batches(large)] == [2, 2, 1] and list(suffix_dedup._batches([])) == []
    assert suffix_dedup._press(1) is suffix_dedup._press(1) and suffix_dedup._unpress() is suffix_dedup._unpress()
