"""Redaction of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import spans as S
from veilwork.functions import text as T

REPLACEMENT = "[REDACTED]"


def plain(df: DataFrame, text: str = "text", entity_types: list[str] | None = None, replacement: str = REPLACEMENT) -> DataFrame:
    """df with spans and redacted: detect, validate, dedupe, replace."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("spans", S.dedupe(S.validate(t, S.detect(t, entity_types))))
    pairs = S.with_replacements(t, F.col("spans"), lambda *_: F.lit(replacement))
    return df.withColumn("redacted", F.when(F.size("spans") == 0, F.col(text)).otherwise(S.splice_disjoint(t, pairs)))


def plain_once(df: DataFrame, text: str = "text") -> DataFrame:
    """plain(), each distinct text redacted once: the response cache as a plan. Worth it where copies abound."""
    keyed = df.withColumn("_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    once = plain(keyed.select("_key", text).dropDuplicates(["_key"]), text)
    return keyed.join(once.select("_key", "spans", "redacted"), "_key").drop("_key")


def apply_mask(text: Column, spans: Column, fmt: str = REPLACEMENT) -> Column:
    """The text with its spans replaced by a format; spans must not overlap."""
    return S.splice_disjoint(text, S.with_replacements(text, spans, lambda value, s, _: T.render(fmt, value, s["type"])))


def apply_hash(text: Column, spans: Column, salt: str = "", length: int = 8) -> Column:
    """The text with its spans replaced by the first digits of their keyed hash."""

    def tag(value: Column, *_) -> Column:
        return F.concat(F.lit("[HASH:"), F.substring(T.hmac_sha256(salt, value), 1, length), F.lit("]"))

    return S.splice_disjoint(text, S.with_replacements(text, spans, tag))


COUNTED = "array<struct<type:string,n:int>>"


def _numbers(rows: Column) -> Column:
    """The number within its type of each row (type, counts) that counts, from 1; null for the others."""

    def step(seen: Column, r: Column) -> tuple[Column, Column]:
        n = F.coalesce(F.get(F.filter(seen, lambda c: c["type"].eqNullSafe(r["type"])), F.lit(0))["n"], F.lit(0)) + 1
        others = F.filter(seen, lambda c: ~c["type"].eqNullSafe(r["type"]))
        after = F.concat(others, F.array(F.struct(r["type"].alias("type"), n.alias("n")))).cast(COUNTED)
        return F.when(r["counts"], after).otherwise(seen), F.array(F.when(r["counts"], n))

    return S.walked(rows, S.empty(COUNTED), step, "array<int>")


FIRSTS = "array<struct<i:int,first:int>>"


def _firsts(keys: Column) -> Column:
    """For each key the place of the first one that equals it."""
    order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("i"))))
    start = F.expr("cast(null as struct<key:string,i:int>)")

    def step(run: Column, k: Column) -> tuple[Column, Column]:
        same = run.isNotNull() & run["key"].eqNullSafe(k["key"])
        first = F.when(same, run["i"]).otherwise(k["i"])
        return F.struct(k["key"].alias("key"), first.alias("i")), F.array(F.struct(k["i"].alias("i"), first.alias("first")))

    return F.transform(F.array_sort(S.walked(order, start, step, FIRSTS)), lambda f: f["first"])


def relex_pairs(text: Column, spans: Column, seed: str | None = None, cache: Column | None = None) -> Column:
    """(span, placeholder): per type numbered in the order of first appearance, equal values alike.

    cache is a map from "[seed|]TYPE|value" to placeholders that go first and use up no number. The work is that of a sort
    of the spans, times the number of types (and, with a cache, that of its entries).
    """
    prefix = f"{seed}|" if seed else ""
    cached = (lambda key: cache[key]) if cache is not None else (lambda key: F.lit(None).cast("string"))
    key = lambda value, s, _: F.concat(F.lit(prefix), F.upper(s["type"]), F.lit("|"), value)

    def paired(spans: Column, keys: Column, firsts: Column) -> Column:
        def row(s: Column, i: Column) -> Column:
            return F.struct(F.upper(s["type"]).alias("type"), ((F.get(firsts, i) == i) & cached(F.get(keys, i)).isNull()).alias("counts"))

        def named(numbers: Column) -> Column:
            def pair(s: Column, i: Column) -> Column:
                name = T.placeholder(s["type"], F.get(numbers, F.get(firsts, i)))
                name = T.seed_signature(name, seed) if seed is not None else name
                return F.struct(s.alias("span"), F.coalesce(cached(F.get(keys, i)), name).alias("replacement"))

            return F.transform(spans, pair)

        return S.let(_numbers(F.transform(spans, row)), named)

    keyed = lambda ss: S.let(S.with_values(text, ss, key), lambda ks: S.let(_firsts(ks), lambda fs: paired(ss, ks, fs)))
    return S.let(spans, keyed)


def typed_pairs(spans: Column) -> Column:
    """(span, placeholder): per type numbered from 1, every occurrence anew."""

    def paired(spans: Column) -> Column:
        rows = F.transform(spans, lambda s: F.struct(F.upper(s["type"]).alias("type"), F.lit(True).alias("counts")))
        pair = lambda ns: F.transform(spans, lambda s, i: F.struct(s.alias("span"), T.placeholder(s["type"], F.get(ns, i)).alias("replacement")))
        return S.let(_numbers(rows), pair)

    return S.let(spans, paired)


def staged(df: DataFrame, text: str, model_spans: Column, circuit_open: Column, salt: str = "", fail: bool = False) -> DataFrame:
    """The staged pipeline: rule gate, model, consensus, fallback, typed placeholders.

    New columns: digest, gate, model, fused, fallback, used_fallback, status, redacted. A row whose model is out and
    whose rules find nothing is unavailable: its text is null, or with fail the query stops.
    """
    t = F.col(text)
    model = F.when(circuit_open, S.empty()).otherwise(F.coalesce(model_spans.cast(S.SPANS), S.empty()))
    df = df.withColumn("digest", T.hmac_sha256(salt, t)).withColumn("gate", S.detect(t)).withColumn("model", model)
    df = df.withColumn("used_fallback", circuit_open).withColumn("fused", S.fuse(F.col("gate"), F.col("model")))
    df = df.withColumn("fallback", F.when(circuit_open, S.empty()).otherwise(F.col("fused")))
    lost = circuit_open & (F.size("fused") == 0)
    df = df.withColumn("status", F.when(lost, "unavailable").otherwise("ok"))
    out = S.splice_disjoint(t, typed_pairs(F.col("fused")))
    stop = F.raise_error(F.lit("model stage unavailable and no rule matches")) if fail else F.lit(None)
    return df.withColumn("redacted", F.when(lost, stop).otherwise(out))


def first_appearance_numbers(entities: DataFrame) -> DataFrame:
    """relex numbers as a window plan over a span table (doc_id, ord, type, value): number per distinct value."""
    firsts = entities.groupBy("doc_id", F.upper("type").alias("type"), "value").agg(F.min("ord").alias("first"))
    order = Window.partitionBy("doc_id", "type").orderBy("first")
    numbered = firsts.withColumn("number", F.dense_rank().over(order))
    return numbered.withColumn("placeholder", T.placeholder(F.col("type"), F.col("number")))


def total_latency(stages: Column) -> Column:
    """Milliseconds of all stages; one that did not run took none."""
    return F.aggregate(stages, F.lit(0.0), lambda acc, ms: acc + F.coalesce(ms, F.lit(0.0)))
