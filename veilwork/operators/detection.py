"""Tables of detected spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import spans as S
from veilwork.functions.text import lookup


def exploded(df: DataFrame, key: str, text: str, spans: Column) -> DataFrame:
    """key, ord, start, end, type, value, a row for each span in its order (from 0)."""
    valued = S.with_values(F.col(text), spans, lambda value, s, _: F.struct(s.alias("span"), value.alias("value")))
    df = df.select(key, F.posexplode(valued).alias("ord", "one"))
    return df.select(key, "ord", *(f"one.span.{c}" for c in ("start", "end", "type")), "one.value", "one.span.confidence")


def span_table(df: DataFrame, key: str, text: str, entity_types: list[str] | None = None) -> DataFrame:
    """exploded() of what the rules find."""
    found = df.select(key, text).withColumn("_spans", S.detect(F.col(text), entity_types))
    return exploded(found, key, text, F.col("_spans")).drop("confidence")


def multi_pass(text: Column, detectors: list, entity_types: list[str] | None = None, most: int = 3) -> Column:
    """Spans of several passes, deduplicated. Equal detectors are one pass: the rules find the same every time."""
    if not 1 <= len(detectors) <= most:
        raise ValueError("passes out of range")
    return S.dedupe(F.concat(*(d(text, entity_types) for d in dict.fromkeys(detectors))))


def normalize_model_output(text: Column, found: Column) -> Column:
    """Spans of a model's answer array<struct<label, value, start, end, score>>.

    Without offsets the first place of the value counts; values that are not there go. Sorted by (start, end).
    """

    def one(x: Column) -> Column:
        start = F.coalesce(x["start"], F.instr(text, x["value"]) - 1)
        end = F.coalesce(x["end"], start + F.length(x["value"]))
        return F.struct(start.alias("start"), end.alias("end"), F.upper(x["label"]).alias("type"), F.coalesce(x["score"], F.lit(1.0)).alias("confidence"))

    spans = F.filter(F.transform(found, one).cast(S.SPANS), lambda s: s["start"] >= 0)
    return S.stable_sort(spans, lambda s: (s["start"], s["end"]))


def bio_spans(tokens: Column, confidence: float = 0.9) -> Column:
    """Spans of tagged tokens array<struct<tag, start, end>>: B- begins one, I- of its type goes on, all else ends it."""

    def step(acc: Column, t: Column) -> Column:
        kind = F.substring(t["tag"], 3, 1000)
        last = F.element_at(acc["out"], -1)
        goes_on = t["tag"].startswith("I-") & acc["open"] & (last["type"] == kind)
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(last.withField("end", t["end"])))
        fresh = F.concat(
            acc["out"],
            F.array(F.struct(t["start"].alias("start"), t["end"].alias("end"), kind.alias("type"), F.lit(confidence).alias("confidence"))),
        )
        begins = t["tag"].startswith("B-") | t["tag"].startswith("I-")
        out = F.when(goes_on, grown).when(begins, fresh).otherwise(acc["out"])
        return F.struct(out.cast(S.SPANS).alias("out"), begins.alias("open"))

    return F.aggregate(tokens, F.struct(S.empty().alias("out"), F.lit(False).alias("open")), step, lambda acc: acc["out"])


#: Fixed values of the demonstration profile, whose rules are its own.
DEMO_RULES = (
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("URL", r"\bhttps?://[^\s<>\"']+"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE_E164", r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"),
)


def _demo_holds(kind: str, value: Column) -> Column:
    """What the demonstration asks of a match beside its pattern."""
    if kind == "CREDIT_CARD":
        return S.luhn_ok(value)
    if kind == "PHONE_E164":
        return F.length(F.regexp_replace(value, r"\D", "")).between(10, 15)
    if kind == "IP":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("int") <= 255)
    return F.lit(True)


def demo_spans(text: Column) -> Column:
    """The demonstration profile: the earliest hit first, of these the longest; what overlaps a chosen one goes."""

    def of(kind: str, pattern: str) -> Column:
        return _typed(F.filter(S.matches(text, pattern), lambda m: _demo_holds(kind, m["value"])), kind)

    found = F.concat(*(of(kind, pattern) for kind, pattern in DEMO_RULES))
    ordered = S.stable_sort(found, lambda s: (s["start"], -(s["end"] - s["start"])))

    def step(kept: Column, s: Column) -> Column:
        return F.when(F.exists(kept, lambda k: S.overlap(k, s)), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(ordered, S.empty(), step)


def _typed(found: Column, kind: str) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"))
    ).cast(S.SPANS)


def typed_labels(table: dict[str, str], label: Column) -> Column:
    """A dataset label's span type; other labels keep their names."""
    return F.coalesce(lookup(table, label), label)
