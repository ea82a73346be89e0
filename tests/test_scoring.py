"""The redaction score and rater agreement: worked examples and properties."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from veilwork.operators import agreement, evaluation, intervals, ranks, scoring
from tests import plain_score as plain
from veilwork.queries import QUERIES, ratings

VEHICLE = 'Vehicle: "5N1AT2MK4FC824170" "2015 Nissan Rogue" plate= 321ABC'
VEHICLE_RED, VEHICLE_YELLOW = [(10, 27), (56, 62)], [(9, 10), (27, 28), (29, 48)]


def total(terms):
    n, d = sum(t[1] for t in terms), sum(t[2] for t in terms)
    return n / d if d else 0.0


def of(terms, kind):
    return [t[1:] for t in terms if t[0] == kind]


def test_micro_cases():
    score = plain.terms
    assert total(score("abcdefghij", [(0, 5)], [], [(0, 3)])) == 3 / 5
    assert total(score("abcXXXdef", [(0, 3)], [], [(0, 3), (3, 6)])) == 0.5
    assert of(score("AAAA bbb CCCC", [(5, 8)], [], [(0, 5), (5, 8)]), "false_positive") == [(0.0, 2.0)]
    assert of(score("AAAA bbb CCCC", [(5, 8)], [], [(0, 4), (5, 8)]), "false_positive") == [(0.0, 1.0)]
    ctx = of(score("VIN: ABC123, name: John M. Doe", [(5, 11)], [(19, 30)], [(5, 11), (19, 25)]), "contextual")
    assert ctx == [(0.0, pytest.approx(1 - 6 / 11))]


def test_vehicle():
    everything = plain.terms(VEHICLE, VEHICLE_RED, VEHICLE_YELLOW, [(0, 62)])
    assert sorted(d for _, d in of(everything, "false_positive")) == [1, 2, 2] and total(everything) == pytest.approx(2 / 7)
    assert total(plain.terms(VEHICLE, VEHICLE_RED, VEHICLE_YELLOW, [(9, 10)])) == 0.0
    assert of(plain.terms(VEHICLE, VEHICLE_RED, VEHICLE_YELLOW, [(27, 28)]), "contextual")[0] == (0.0, 0.5)


def test_structure():
    s = plain.Structure("127.0.0.1", [(0, 3), (4, 7), (8, 9)], [])
    assert s.reds.sets() == [[0, 1, 2]] and s.markers == {"."}
    s = plain.Structure("(415) 555", [(0, 5), (6, 9)], [])
    assert len(s.reds.sets()) == 2 and s.markers == {")", " "}
    assert plain.Structure("[ABC]", [], [(1, 4)]).pairs == [(0, 4)]
    assert plain.Structure('"ABC" "DEF"', [], [(1, 4), (7, 10)]).pairs == [(0, 4), (6, 10)]


def test_perfect_and_empty_predictions():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab1 ()[]\"/.,\n") for _ in range(60))
        places = sorted(rng.sample(range(61), 8))
        spans = list(zip(places[::2], places[1::2]))
        red, yellow = spans[:2], spans[2:]
        perfect = plain.terms(text, red, yellow, red + yellow)
        assert total(perfect) == pytest.approx(1.0) and not of(perfect, "false_positive")
        assert total(plain.terms(text, red, yellow, [])) == 0.0
        some = total(plain.terms(text, red, yellow, [(rng.randrange(60), rng.randrange(61)) for _ in range(4)]))
        assert 0 <= some <= 1


def test_plan_equals_plain_loops(spark):
    """Random texts of delimiters and connectors with nested, crossing and repeated spans, and chains of pairs."""
    rng = random.Random(7)
    kinds = ["mandatory", "contextual", "contextual", "contextual"]
    rows = []
    for i in range(400):
        n = rng.choice([0, 8, 30, 60, 600])
        text = "".join(rng.choice("ab1é ()[]<>\"'/.,\n\t") for _ in range(n))
        some = lambda k, wide: [(a, min(n, a + 1 + rng.randrange(wide))) for a in (rng.randrange(n) for _ in range(k if n else 0))]  # noqa: E731, B023
        spans = [(a, b, rng.choice(kinds[i % 2 :])) for a, b in some(rng.randrange(20), rng.choice([1, 3, 12]))]
        rows.append((i, text, spans + spans[:1], some(rng.randrange(5), 20)))
    chain = "".join(f'"a" {c}' for c in "bcdefgh")
    marks = [(i, i + 1, "contextual") for i, c in enumerate(chain) if c != " "]
    rows += [(400, chain, marks, [(0, 1)]), (401, None, None, None), (402, "abcdef", None, [(0, 6)]), (403, "((((a))))", [(4, 5, "contextual"), (0, 1, "contextual")], [(0, 1)])]
    span = "array<struct<start:int,end:int,category:string>>"
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {span}, predictions array<struct<start:int,end:int>>")
    found = {}
    for r in scoring.score_terms(df).collect():
        found.setdefault(r["doc_id"], []).append((r["kind"], round(r["n"], 9), round(r["d"], 9)))
    for i, text, spans, predicted in rows:
        of_kind = lambda c: [(a, b) for a, b, k in spans or [] if k == c]  # noqa: E731, B023
        wanted = [(k, round(n, 9), round(d, 9)) for k, n, d in plain.terms(text or "", of_kind("mandatory"), of_kind("contextual"), predicted or [])]
        assert sorted(found.get(i, [])) == sorted(wanted), (i, text, spans, predicted)
    assert any(k == "skipped" for own in found.values() for k, _, _ in own)
    assert scoring.scores(df).count() == len(rows)
    assert scoring.scores(df.limit(0)).collect() == []


def test_holding(spark):
    rng = random.Random(9)
    some = lambda k: [(rng.randrange(4), a, a + rng.randrange(1, 9)) for a in (rng.randrange(30) for _ in range(k))]
    spans, others = some(60), some(12)
    of = lambda rows: spark.createDataFrame(rows, "doc_id int, start int, end int")
    found = sorted(tuple(r) for r in intervals.holding(of(spans), of(others)).collect())
    assert found == sorted((d, a, b, any(d == x and a <= c and e <= b for x, c, e in others)) for d, a, b in spans)


def test_runs_and_differences_by_characters():
    rng = random.Random(2)
    chars = lambda runs: {c for a, b in runs for c in range(a, b)}
    for _ in range(500):
        some = lambda: [(rng.randrange(-3, 30), rng.randrange(-3, 33)) for _ in range(rng.randrange(5))]
        runs, others = plain.runs_of(some(), 30), plain.runs_of(some(), 30)
        left = plain.outside(runs, others)
        assert chars(left) == chars(runs) - chars(others)
        assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:])) and left == sorted(left)


def test_report_of_the_fixture(spark):
    rows = {r["category"]: r for r in QUERIES["rscore_report"](spark, "").collect()}
    assert rows[None]["mean"] == pytest.approx(1 / 6) and rows["emails"]["mean"] == pytest.approx(1 / 3)
    assert (rows[None]["n"], rows["financial"]["n"], rows["operations"]["n"]) == (6, 1, 2)
    partial = [r["r"] for r in QUERIES["rscore_per_doc_predictions"](spark, "").collect()]
    assert all(0 < r <= 1 for r in partial) and len(partial) == 6


def test_agreement(spark):
    got = ratings(spark)
    assert agreement.pairwise(got).first()[0] == pytest.approx(0.333, abs=1e-3)
    kinds = {r["kind"]: r for r in agreement.by_kind(got).collect()}
    assert [round(kinds[k]["disagreement"], 3) for k in ("red", "yellow", "gap_a", "gap_b")] == [0.333, 0.667, 0, 0.333]
    assert agreement.alpha(got).first()[0] == pytest.approx(0.286, abs=1e-3)
    alphas = {r["kind"]: r["alpha"] for r in agreement.alpha_by_kind(got).collect()}
    assert alphas["red"] == pytest.approx(0.222, abs=1e-3) and alphas["yellow"] == pytest.approx(-0.222, abs=1e-3)
    pooled = {r["kind"]: r["alpha"] for r in QUERIES["alpha_pooled_gaps"](spark, "").collect()}
    assert pooled["gap"] == pytest.approx(0.297, abs=1e-3)
    assert tuple(agreement.report(got).first())[:3] == (10, 14, 26)
    lone = got.where("rater = 'user1'")
    assert agreement.alpha(lone).first()[0] is not None and {r["alpha"] for r in agreement.alpha_by_kind(lone).collect()} == {0.0}
    assert agreement.pairwise(got.where("false")).first()[0] == 0.0 and agreement.alpha(got.where("false")).first()[0] == 1.0


def test_average_ranks(spark):
    rng = random.Random(5)
    for n, most in ((0, 1), (1, 1), (500, 40), (700, 10**6)):
        values = [rng.randrange(most) / 4 for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        found = {r["v"]: r["r"] for r in agreement.average_rank(df, "v", "r").collect()}
        assert found == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}


def test_spearman(spark):
    line = spark.createDataFrame([(float(i), float(2 * i)) for i in range(5)], "x double, y double")
    assert agreement.spearman(line, "x", "y") == (1.0, 0.0)
    assert agreement.spearman(line.withColumn("y", -F.col("y")), "x", "y") == (-1.0, 0.0)
    tied = spark.createDataFrame([(1.0, 3.0), (1.0, 1.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
    rho, p = agreement.spearman(tied, "x", "y")
    assert rho == pytest.approx(1 - 6 * ((1.5 - 4) ** 2 + 0.25 + 0.25 + (4 - 2.5) ** 2) / (4 * 15)) and 0 < p < 1
    with pytest.raises(ValueError):
        agreement.spearman(line.limit(2), "x", "y")


@pytest.mark.parametrize("exclusive", [False, True])
def test_quantiles(spark, monkeypatch, exclusive):
    monkeypatch.setattr(ranks, "PART_ROWS", 20)  # groups go over several parts
    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(101)], "b": [1.0, 2.0], "c": [5.0], None: [rng.randrange(3) * 1.0 for _ in range(40)]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    method = "exclusive" if exclusive else "inclusive"
    out = {r["g"]: r for r in evaluation.quantiles(df, ["g"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95}, exclusive).collect()}
    assert set(out) == set(groups)
    for k, own in groups.items():
        cuts = statistics.quantiles(own, n=100, method=method) if len(own) > 1 else own * 99
        assert [out[k]["low"], out[k]["mid"], out[k]["high"]] == pytest.approx([cuts[4], cuts[49], cuts[94]]), k
    assert evaluation.quantiles(df.limit(0), ["g"], "v", {"p": 0.5}).collect() == []


SCORED = "doc_id long, text string, spans array<struct<start:int,end:int,category:string>>, predictions array<struct<start:int,end:int>>"


def test_what_follows_the_last_span_connects_nothing(spark):
    df = spark.createDataFrame([(1, "b   .   b.", [(4, 5, "contextual"), (8, 9, "contextual")], [(4, 5)])], SCORED)
    found = sorted((r["kind"], r["n"], r["d"]) for r in scoring.score_terms(df).collect())
    assert found == sorted(plain.terms("b   .   b.", [], [(4, 5), (8, 9)], [(4, 5)])) == [("contextual", 1.0, 1.0), ("skipped", 0.0, 0.0)]


def test_texts_without_pairs_move_once(spark):
    """The scores of texts without pairs of delimiters come from one shuffle of places, and nothing is stored but what facts() tells."""
    df = spark.createDataFrame([(i, "Ab cd, 12 3. Ef", [(0, 2, "contextual"), (7, 9, "contextual")], [(0, 5)]) for i in range(50)], SCORED)
    rows = scoring._plain_terms(scoring.facts(df)).groupBy("doc_id").agg(F.sum(F.col("d") + F.col("fp") + F.col("whole")).alias("d"))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    shuffles = rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1 and "Python" not in plan
    assert {r["d"] for r in rows.collect()} == {sum(d for _, _, d in plain.terms("Ab cd, 12 3. Ef", [], [(0, 2), (7, 9)], [(0, 5)]))}
