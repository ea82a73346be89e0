"""Detection and span algebra against plain restatements."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import plain
from veilwork import fixtures as X
from veilwork.functions import spans as S
from veilwork.functions import text as T
from veilwork.functions.rules import active_rules
from veilwork.operators import chunks, detection, redaction
from veilwork.queries import QUERIES

PIECES = [
    "alice@example.com", "a.b+c@mail.example.co", "10.0.0.1", "999.1.1.1", "4532015112830366", "4532 0151 1283 0366", "4532-0151-1283-0367",
    "+1 415-555-2671", "+442071838750", "123-45-6789", "000-12-3456", "123 45 6789", "GB00FAKE00000000000000", "https://x.example/a?b=1.",
    "http://a", "😀", "é", "word", " ", "\n", ",", "(", ")", "٤", "\x1c", "\u00a0", "-", "12", "@", ".",
]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_detection_on_random_texts(spark):
    rng = random.Random(1)
    texts = [(i, rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randrange(12)))) for i in range(600)]
    df = spark.createDataFrame(texts + [(1000, None)], "id long, text string")
    found = {r["id"]: [(s["start"], s["end"], s["type"]) for s in r["s"]] for r in df.select("id", S.detect(F.col("text")).alias("s")).collect()}
    wrong = [(t, found[i], plain.detect(t)) for i, t in texts if found[i] != plain.detect(t)]
    assert not wrong, wrong[:3]
    assert found[1000] == []


def test_entity_types():
    assert [r.type for r in active_rules([" ipv4", "Phone_Number", "nonsense"])] == ["IP_ADDRESS", "PHONE_E164"]
    assert active_rules(["person"]) == () and len(active_rules([])) == len(active_rules(None)) == 7


@pytest.mark.parametrize("number, good", [("4532015112830366", True), ("4532015112830367", False), ("1234567890", False), ("4532 0151-1283 0366", True), ("", False)])
def test_luhn(spark, number, good):
    assert spark.range(1).select(S.luhn_ok(F.lit(number))).first()[0] is good


def random_spans(rng, n=8, length=20):
    out = []
    for _ in range(rng.randrange(n)):
        a = rng.randrange(length)
        out.append((a, a + rng.randrange(1, 8), rng.choice("AB"), rng.choice([0.2, 0.5, 0.5, 0.9])))
    return out


def test_dedupe_and_fuse_on_random_spans(spark):
    rng = random.Random(2)
    cases = [(i, random_spans(rng), random_spans(rng)) for i in range(800)]
    df = spark.createDataFrame(cases, f"id long, a {S.SPANS}, b {S.SPANS}")
    for r in df.select("id", "a", "b", S.dedupe(F.col("a")).alias("d"), S.fuse(F.col("a"), F.col("b")).alias("f")).collect():
        a, b = [tuple(s) for s in r["a"]], [tuple(s) for s in r["b"]]
        assert [tuple(s) for s in r["d"]] == plain.dedupe(a)
        added = [m for m in b if m[3] >= 0.5 and not any(plain.overlap(x, m) for x in a)]
        assert [tuple(s) for s in r["f"]] == plain.dedupe(a + added)


def test_splice_and_remap_on_random_texts(spark):
    rng = random.Random(3)
    cases = []
    for i in range(300):
        text = "".join(rng.choice("ab😀é \n") for _ in range(rng.randrange(25)))
        places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(4))))
        pairs = [(((a, b, "X", 1.0)), rng.choice(["", "[R]", "longer text"])) for a, b in zip(places[::2], places[1::2])]
        rng.shuffle(pairs)
        cases.append((i, text, pairs))
    df = spark.createDataFrame(cases, f"id long, text string, pairs array<struct<span:{S.SPAN},replacement:string>>")
    text, pairs = F.col("text"), F.col("pairs")
    places = F.sequence(F.lit(-1), F.lit(70))
    out = df.select("id", S.splice(text, pairs).alias("s"), S.splice_disjoint(text, pairs).alias("d"), F.transform(places, lambda p: S.remap(S.segments(text, pairs), p)).alias("o"))
    found = {r["id"]: r for r in out.collect()}
    for i, text, pairs in cases:
        bare = [((s[0], s[1]), new) for s, new in pairs]
        assert found[i]["s"] == found[i]["d"] == plain.splice(text, bare)
        want = plain.origins(text, bare)
        assert found[i]["o"][0] == 0 and found[i]["o"][1 : len(want) + 1] == want


def test_splice_of_overlapping_spans_goes_from_the_right(spark):
    pairs = [((0, 5, "A", 1.0), "[A]"), ((3, 8, "B", 1.0), "[BBBBBB]")]
    df = spark.createDataFrame([("0123456789", pairs)], f"text string, pairs array<struct<span:{S.SPAN},replacement:string>>")
    assert df.select(S.splice(F.col("text"), F.col("pairs"))).first()[0] == "[A]BBBBB]89"


def test_relex(spark):
    df = spark.createDataFrame([("Alice met Alice", [(0, 5, "person", 1.0), (10, 15, "person", 1.0)])], f"text string, spans {S.SPANS}")
    text, spans = F.col("text"), F.col("spans")
    one = lambda **o: df.select(S.splice_disjoint(text, redaction.relex_pairs(text, spans, **o))).first()[0]
    assert one() == "[PERSON_0001] met [PERSON_0001]"
    signed = one(seed="s")
    assert signed.startswith("[PERSON_0001]-") and signed == one(seed="s") != one(seed="t")
    assert one(cache=F.create_map(F.lit("PERSON|Alice"), F.lit("[X]"))) == "[X] met [X]"
    typed = df.select(S.splice_disjoint(text, redaction.typed_pairs(spans))).first()[0]
    assert typed == "[PERSON_0001] met [PERSON_0002]"


def test_hmac_and_signatures(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("",), ("é😀",), ("a" * 500,)], "t string")
    for key in ("", "pepper", "k" * 100):
        for r in df.select("t", T.hmac_sha256(key, F.col("t")).alias("h")).collect():
            assert r["h"] == hmac.new(key.encode(), r["t"].encode(), "sha256").hexdigest()
    signed = df.limit(1).select(T.seed_signature(F.lit("[A_0001]"), "x")).first()[0]
    assert signed == "[A_0001]-" + hashlib.sha256(b"x|[A_0001]").hexdigest()[:4]


def test_formats_and_masks(spark):
    df = spark.createDataFrame([("mail a@b.example", [(5, 16, "EMAIL", 1.0)])], f"text string, spans {S.SPANS}")
    mask = lambda f: df.select(redaction.apply_mask(F.col("text"), F.col("spans"), f)).first()[0]
    assert mask("[{type}/{last4}/{text}/{other}]") == "mail [EMAIL/mple/a@b.example/{other}]"
    assert df.select(redaction.apply_hash(F.col("text"), F.col("spans"), "s", 6)).first()[0].startswith("mail [HASH:")


@pytest.mark.parametrize("chars, most", [(10, 4), (10, 100), (3, 7), (1, 1), (100, 5)])
def test_chunks(chars, most):
    rng = random.Random(chars)
    for text in ["", "a" * 40, "😀" * 6, *("".join(rng.choice("aé日😀") for _ in range(rng.randrange(40))) for _ in range(100))]:
        found = chunks.split_chunks(text, chars, most)
        assert "".join(found) == text
        for i, piece in enumerate(found):
            size = len(piece.encode())
            assert len(piece) <= chars and (size <= most or len(piece) == 1)
            if i + 1 < len(found):  # the next character would not fit
                assert len(piece) == chars or size + len(found[i + 1][0].encode()) > most


def test_multi_pass(spark):
    calls = []

    def detector(text, types):
        calls.append(1)
        return S.detect(text, types)

    df = spark.createDataFrame([("a@b.example",)], "text string")
    assert df.select(F.size(detection.multi_pass(F.col("text"), [detector] * 3))).first()[0] == 1 and len(calls) == 1
    for n in (0, 4):
        with pytest.raises(ValueError):
            detection.multi_pass(F.col("text"), [detector] * n)


def test_fixture_texts(spark):
    from veilwork.queries import QUERIES

    found = {(r["doc_id"], r["start"], r["end"], r["type"]) for r in QUERIES["detect_fixture_texts"](spark, "").collect()}
    texts = spark.sql(f"SELECT * FROM VALUES {X.TEXTS} AS t(doc_id, text)").collect()
    assert found == {(r["doc_id"], *s) for r in texts for s in plain.detect(r["text"])}


def test_demonstration_profile(spark):
    text = "Call (415) 555-2671 or +1 415.555.2671, 300.1.1.1 and 10.0.0.1, 123-45-6789, card 4532 0151 1283 0366, https://a.example/x."
    df = spark.createDataFrame([(text,)], "text string")
    spans = df.select(detection.demo_spans(F.col("text"))).first()[0]
    found = [(s["type"], text[s["start"] : s["end"]]) for s in spans]
    assert found == [
        ("PHONE_E164", "(415) 555-2671"), ("PHONE_E164", "+1 415.555.2671"), ("IP", "10.0.0.1"), ("SSN", "123-45-6789"),
        ("CREDIT_CARD", "4532 0151 1283 0366"), ("URL", "https://a.example/x."),
    ]
    assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]))


def test_model_detector_keeps_every_detection(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        rules = [(*s, 1.0) for s in plain.detect(r["text"])]
        model = [(m.start(), m.end(), "WORD", 0.9) for m in re.finditer("the", r["text"])]
        fused = plain.dedupe(rules + [m for m in model if not any(plain.overlap(x, m) for x in rules)])
        seen, pairs = Counter(), []
        for start, end, kind, _ in fused:
            seen[kind] += 1
            pairs.append(((start, end), f"[{kind}_{seen[kind]:04d}]"))
        digest = hashlib.sha256(plain.splice(r["text"], pairs).encode()).hexdigest()
        want[r["doc_id"]] = (len(model), len(fused), digest)
    assert sum(n > 5 for n, _, _ in want.values()) > 20
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["model_detector"](spark, sf_dir).collect()} == want


def test_every_document_has_its_event_stream(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert any(not t.isascii() for t in texts.values())
    want = set()
    for doc_id, text in texts.items():
        n = len(chunks.split_chunks(text, 500, 520))
        want |= {(doc_id, i, f'data: {{"chunk_ix":{i}}}\n\n') for i in range(n)} | {(doc_id, n, "data: [DONE]\n\n")}
    rows = QUERIES["sse_stream_all"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {(r["doc_id"], r["event_ix"], r["line"]) for r in rows} == want


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300])
def test_walks_carry_their_state_over_blocks(spark, n):
    rows = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(rows,)], "rows array<int>")
    step = lambda s, r: (s + r, F.when(r % 3 == 0, F.array(s)).otherwise(S.empty("array<int>")))
    got = df.select(S.walked(F.col("rows"), F.lit(0), step, "array<int>", lambda s: F.array(s))).first()[0]
    want, total = [], 0
    for r in rows:
        want += [total] if r % 3 == 0 else []
        total += r
    assert got == [*want, total]


def test_pieces_of_texts(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else "\n" if i % 5 == 0 else chr(97 + i % 26) for i in range(2000))
    places = [(0, 0), (0, 2000), (511, 513), (512, 512), (512, 1024), (1023, 1024), (1999, 2000), (5, 1700), (1990, 2500), (3000, 3001)]
    df = spark.createDataFrame([(text, places)], "text string, places array<struct<start:int,end:int>>")
    got = df.select(S.with_values(F.col("text"), F.col("places"), lambda v, *_: v)).first()[0]
    assert got == [text[a:b] for a, b in places]


def test_long_lists_of_spans_by_plain_loops(spark):
    """Folds, placeholders and consensus over many spans of one text, with chains, ties and values that come again."""
    rng = random.Random(11)
    text = " ".join(rng.choice(["anna", "bert", "cleo", "dörte", "😀"]) for _ in range(4000))
    some = lambda: [(a, a + rng.randrange(1, 30), rng.choice("ABc"), rng.choice([0.2, 0.5, 0.9])) for a in rng.choices(range(len(text) - 30), k=1500)]
    rules, model = some()[:400], some()
    df = spark.createDataFrame([(text, rules, model)], f"text string, rules {S.SPANS}, model {S.SPANS}")
    t, kept = F.col("text"), S.dedupe(F.col("model"))
    fused = S.fuse(F.col("rules"), F.col("model"))
    r = df.select(kept.alias("kept"), fused.alias("fused"), redaction.relex_pairs(t, kept).alias("relex"), redaction.typed_pairs(kept).alias("typed")).first()
    want = plain.dedupe(model)
    assert [tuple(s) for s in r["kept"]] == want
    added = [m for m in model if m[3] >= 0.5 and not any(plain.overlap(x, m) for x in rules)]
    assert [tuple(s) for s in r["fused"]] == plain.dedupe(rules + added)
    names, counts, typed = {}, {}, []
    for start, end, kind, _ in want:
        mine = names.setdefault(kind.upper(), {})
        mine.setdefault(text[start:end], len(mine) + 1)
        counts[kind.upper()] = counts.get(kind.upper(), 0) + 1
        typed.append(f"[{kind.upper()}_{counts[kind.upper()]:04d}]")
    assert [p["replacement"] for p in r["relex"]] == [f"[{k.upper()}_{names[k.upper()][text[a:b]]:04d}]" for a, b, k, _ in want]
    assert [p["replacement"] for p in r["typed"]] == typed


def test_relex_with_a_cache_that_knows_some_values(spark):
    spans = [(0, 1, "P", 1.0), (2, 3, "P", 1.0), (4, 5, "P", 1.0), (6, 7, "Q", 1.0)]
    df = spark.createDataFrame([("a b a c", spans)], f"text string, spans {S.SPANS}")
    pairs = redaction.relex_pairs(F.col("text"), F.col("spans"), cache=F.create_map(F.lit("P|a"), F.lit("[X]")))
    assert [p["replacement"] for p in df.select(pairs).first()[0]] == ["[X]", "[P_0001]", "[X]", "[Q_0001]"]


def test_a_hundred_thousand_spans_in_one_text(spark):
    """The work is that of a sort: a quadratic one would not end within the test's patience."""
    n = 100_000
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("é u"), i % 5000, F.lit("@ab.de"))), " ").alias("text"))
    done = redaction.plain(df).withColumn("relexed", S.splice_disjoint(F.col("text"), redaction.relex_pairs(F.col("text"), F.col("spans"))))
    r = done.select(F.size("spans").alias("n"), "redacted", "relexed").first()
    assert r["n"] == n and r["redacted"] == " ".join(["é [REDACTED]"] * n)
    assert r["relexed"] == " ".join(f"é [EMAIL_{i % 5000 + 1:04d}]" for i in range(n))


def test_matches_by_characters(spark):
    """Dense or not, with and without the sign that parts matches; null texts have none."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("Ab1 é😀\x01\n"[: rng.choice([6, 8])]) for _ in range(rng.choice([0, 1, 5, 40, 700]))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for pattern in (r"[A-Z][a-z]*|[0-9]+", r"[^ ]"):
        for dense in (False, True):
            found = {r["i"]: [tuple(m) for m in r["m"]] for r in df.select("i", S.matches(F.col("t"), pattern, dense=dense).alias("m")).collect()}
            assert found == {i: [(*m.span(), m.group()) for m in re.finditer(pattern, t or "")] for i, t in enumerate([*texts, None])}
