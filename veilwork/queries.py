"""The registered queries, name by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork import fixtures as X
from veilwork.functions import records
from veilwork.functions import spans as S
from veilwork.functions import text as T
from veilwork.functions.rules import CATEGORY_LABELS, DATASET_LABELS
from veilwork.operators import agreement, chunks, detection, evaluation, intervals, models, operations, redaction, scoring
from veilwork.plans import policy
from veilwork.sources import corpus, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SALT = "pepper"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def texts(spark: SparkSession) -> DataFrame:
    return values(spark, X.TEXTS, "doc_id, text").withColumn("doc_id", F.col("doc_id").cast("long"))


def numbered(df: DataFrame) -> DataFrame:
    """Integer columns as long, for both engines alike."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


def _detect(name: str, source: str, key: str, text: str, types: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return numbered(detection.span_table(table(spark, sf_dir, source), key, text, types))

    QUERIES[name] = run


_detect("detect_email", "documents", "doc_id", "text", ["EMAIL"])
_detect("detect_ip", "documents", "doc_id", "text", ["IP_ADDRESS"])
_detect("detect_card_luhn", "documents", "doc_id", "text", ["CREDIT_CARD"])
_detect("detect_url", "pages", "page_id", "url", ["URL"])
_detect("detect_entity_filter_alias", "documents", "doc_id", "text", [" ipv4", "Email", "no such type"])
_detect("detect_unknown_types_only", "documents", "doc_id", "text", ["person", "address"])


@query
def detect_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "text").union(texts(spark).withColumn("doc_id", -F.col("doc_id")))
    return numbered(detection.span_table(both, "doc_id", "text", ["IBAN"]))


@query
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "text").union(texts(spark).withColumn("doc_id", -F.col("doc_id")))
    return numbered(detection.span_table(both, "doc_id", "text", ["PHONE"]))


@query
def detect_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "text").union(texts(spark).withColumn("doc_id", -F.col("doc_id")))
    return numbered(detection.span_table(both, "doc_id", "text", ["SSN"]))


@query
def detect_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(detection.span_table(table(spark, sf_dir, "documents"), "doc_id", "text").drop("ord"))


@query
def detect_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(detection.span_table(table(spark, sf_dir, "pages"), "page_id", "html").drop("ord"))


@query
def detect_all_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    return numbered(detection.span_table(turns, "id", "text").drop("ord"))


@query
def detect_fixture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(detection.span_table(texts(spark), "doc_id", "text"))


def _counts(by: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select(by, F.explode(S.detect(F.col("text"))).alias("s"))
        return docs.groupBy(by, F.col("s.type").alias("type")).agg(F.count("*").alias("n"))

    return run


QUERIES["detect_counts_by_lang"] = _counts("lang")
QUERIES["detect_counts_by_source"] = _counts("source")


@query
def detect_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.plain(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_spans"), S.listed(F.col("spans")).alias("spans"))


@query
def detect_demo_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return numbered(detection.exploded(docs, "doc_id", "text", detection.demo_spans(F.col("text"))).drop("confidence"))


@query
def multi_pass_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = detection.multi_pass(F.col("text"), [S.detect, S.detect, S.detect])
    return numbered(detection.exploded(docs, "doc_id", "text", spans).drop("confidence"))


@query
def model_output_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(
        spark,
        """(1, 'Alice met Bob and Alice', 'person', 'Bob', null, null, 0.8), (1, 'Alice met Bob and Alice', 'person', 'Alice', null, null, 0.9),
           (1, 'Alice met Bob and Alice', 'city', 'Paris', null, null, 0.9), (2, 'in Rome', 'city', 'Rome', 3, 7, null)""",
        "doc_id, text, label, value, start, `end`, score",
    )
    found = rows.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list(F.struct("label", "value", "start", "end", "score"))).alias("x"))
    spans = detection.normalize_model_output(F.col("text"), F.col("x"))
    return numbered(detection.exploded(found, "doc_id", "text", spans).withColumn("doc_id", F.col("doc_id").cast("long")))


@query
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(
        spark,
        """(1, 0, 'B-PER', 0, 4), (1, 1, 'I-PER', 5, 9), (1, 2, 'O', 10, 12), (1, 3, 'I-LOC', 13, 17), (1, 4, 'B-LOC', 18, 22),
           (1, 5, 'I-PER', 23, 27), (2, 0, 'O', 0, 3)""",
        "doc_id, ix, tag, start, `end`",
    )
    tagged = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ix", "tag", "start", "end"))).alias("x"))
    spans = detection.bio_spans(F.col("x"))
    return numbered(tagged.select(F.col("doc_id").cast("long"), F.posexplode(spans).alias("ord", "s")).select("doc_id", "ord", "s.*"))


@query
def sanitize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, X.LABELS, "label").select("label", T.sanitize_label(F.col("label")).alias("type"))


@query
def dataset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*DATASET_LABELS, "UNHEARDOF"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    return df.select("label", detection.typed_labels(DATASET_LABELS, F.col("label")).alias("type"))


@query
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.category(F.col("text")).alias("category"))
    return docs.union(texts(spark).select(-F.col("doc_id"), T.category(F.col("text"))))


@query
def classify_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [label for own in CATEGORY_LABELS.values() for label in own]
    df = spark.createDataFrame([(n, [n, "CITY"]) for n in names], "label string, labels array<string>")
    return df.select("label", T.category(F.lit("dear court"), F.col("labels")).alias("category"))


@query
def normalize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \r\n"), "text", F.lit("\r\n\t")).alias("text"))
    return docs.select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("digest"))


# -- span algebra ------------------------------------------------------------------------------------------------------


def span_cases(spark: SparkSession) -> DataFrame:
    rows = values(spark, X.SPANS, "case_id, ord, start, `end`, type, confidence")
    one = F.struct("ord", "start", "end", "type", F.col("confidence").cast("double").alias("confidence"))
    grouped = rows.groupBy(F.col("case_id").cast("long").alias("case_id")).agg(F.sort_array(F.collect_list(one)).alias("x"))
    spans = F.transform("x", lambda s: F.struct(s["start"], s["end"], s["type"], s["confidence"]).cast(S.SPAN))
    return grouped.select("case_id", spans.alias("spans"))


@query
def validate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.OFFSETS, "case_id, ord, start, `end`")
    one = F.struct("start", "end", F.lit("X").alias("type"), F.lit(1.0).alias("confidence")).cast(S.SPAN)
    grouped = rows.groupBy("case_id").agg(F.collect_list(one).alias("s"))
    kept = grouped.select("case_id", F.explode(S.validate(F.lit("hello world"), F.col("s"))).alias("k"))
    return numbered(kept.select("case_id", "k.start", "k.end"))


@query
def dedupe_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_cases(spark).select("case_id", S.listed(S.dedupe(F.col("spans"))).alias("kept"))


def _sides(spark: SparkSession, side: str) -> DataFrame:
    return values(spark, X.SIDES, "doc_id, side, start, `end`, confidence").where(F.col("side") == side)


@query
def fuse_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.SIDES, "doc_id, side, start, `end`, confidence")
    one = F.struct("start", "end", "side", F.col("confidence").cast("double")).cast(S.SPAN)
    side = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, one)))
    both = rows.groupBy("doc_id").agg(side("rule").alias("r"), side("model").alias("m"))
    fused = both.select("doc_id", F.explode(S.fuse(F.col("r"), F.col("m"))).alias("s"))
    return numbered(fused.select("doc_id", "s.start", "s.end", F.col("s.type").alias("side")))


@query
def fuse_by_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, model = _sides(spark, "rule"), _sides(spark, "model").where("confidence >= 0.5")
    fused = rules.unionByName(intervals.untouched(model, rules))
    return numbered(fused.select("doc_id", "start", "end", "side"))


@query
def apply_and_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("Alice and Bob")
    pairs = F.expr(
        "array(struct(struct(0 as start, 5 as end) as span, '[P1]' as replacement), struct(struct(10 as start, 13 as end) as span, '[P2]' as replacement))"
    )
    seg = S.segments(text, pairs)
    places = spark.range(-1, 13).select(F.col("id").alias("place"), S.remap(seg, F.col("id").cast("int")).cast("long").alias("origin"))
    return places.withColumn("text", S.splice(text, pairs))


@query
def split_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    cut = S.split_on_newlines(F.col("text"), whole, "array<struct<start:int,end:int>>")
    lines = docs.select("doc_id", F.posexplode(cut).alias("ord", "s"))
    return numbered(lines.select("doc_id", "ord", "s.start", "s.end"))


@query
def normalize_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _corpus(spark, "PREDICTIONS").select("doc_id", F.explode("spans").alias("s"))
    return numbered(found.select("doc_id", "s.start", "s.end", "s.category"))


def _interval(spark: SparkSession, side: str) -> tuple[DataFrame, DataFrame]:
    rows = values(spark, X.INTERVALS, "doc_id, side, start, `end`").where(F.col("side") == side).drop("side")
    return rows, values(spark, X.LENGTHS, "doc_id, length")


@query
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(intervals.union(*_interval(spark, "prediction")))


@query
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, lengths = _interval(spark, "support")
    return numbered(intervals.gaps(intervals.union(spans, lengths), lengths))


@query
def false_positive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, lengths = _interval(spark, "prediction")
    support = intervals.union(_interval(spark, "support")[0], lengths)
    return numbered(intervals.difference(intervals.union(spans, lengths), support))


@query
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, lengths = _interval(spark, "prediction")
    support = _interval(spark, "support")[0].withColumn("span_id", F.concat_ws("-", "start", "end"))
    return numbered(intervals.coverage(support, intervals.union(spans, lengths)))


@query
def touched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(intervals.touched(_interval(spark, "support")[0], _interval(spark, "prediction")[0].where("start < end")))


#: Rules and demonstration rules whose spans in documents are compared with each other.
SIDE_RULES = ("EMAIL", "IP_ADDRESS", "CREDIT_CARD", "IBAN", "URL")
SIDE_DEMO = ("EMAIL", "URL", "PHONE_E164")


def _document_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of rules, each with 40 characters around it; spans of demonstration rules, all of them with an id; lengths of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = detection.span_table(docs, "doc_id", "text", list(SIDE_RULES)).select("doc_id", (F.col("start") - 40).alias("start"), (F.col("end") + 40).alias("end"))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(S.matches(F.col("text"), pattern), lambda m: F.struct(F.lit(kind).alias("type"), m["start"].alias("start"), m["end"].alias("end")))

    found = [of(kind, pattern) for kind, pattern in detection.DEMO_RULES if kind in SIDE_DEMO]
    demo = docs.select("doc_id", F.explode(F.concat(*found)).alias("s")).select("doc_id", "s.*")
    demo = demo.select("doc_id", F.concat_ws("-", "type", "start", "end").alias("span_id"), "start", "end")
    return rules, demo, docs.select("doc_id", F.length("text").alias("length"))


@query
def document_interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _, lengths = _document_sides(spark, sf_dir)
    return numbered(intervals.gaps(intervals.union(rules, lengths), lengths))


@query
def document_interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What demonstration rules find, with 60 characters around it, beyond what the rules' surroundings cover."""
    rules, demo, lengths = _document_sides(spark, sf_dir)
    wide = demo.select("doc_id", (F.col("start") - 60).alias("start"), (F.col("end") + 60).alias("end"))
    return numbered(intervals.difference(intervals.union(wide, lengths), intervals.union(rules, lengths)))


@query
def document_span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, demo, lengths = _document_sides(spark, sf_dir)
    wide = demo.select("doc_id", "span_id", (F.col("start") - 60).alias("start"), (F.col("end") + 60).alias("end"))
    covered = intervals.coverage(wide, intervals.union(rules, lengths))
    return numbered(covered.withColumn("coverage", F.round("coverage", 9)))


@query
def document_touched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, demo, _ = _document_sides(spark, sf_dir)
    return numbered(intervals.touched(demo, rules))


@query
def document_fused_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule spans' surroundings, and what demonstration rules find outside of them."""
    rules, demo, _ = _document_sides(spark, sf_dir)
    sure = rules.withColumn("side", F.lit("rule"))
    return numbered(sure.unionByName(intervals.untouched(demo, rules).drop("span_id").withColumn("side", F.lit("demo"))))


@query
def document_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and gaps over all documents: what the rules find, widened by 40 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wide = detection.span_table(docs, "doc_id", "text").select("doc_id", (F.col("start") - 40).alias("start"), (F.col("end") + 40).alias("end"))
    return numbered(intervals.union(wide, docs.select("doc_id", F.length("text").alias("length"))))


# -- strategies and policies -------------------------------------------------------------------------------------------


@query
def redact_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.plain(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted")


@query
def redact_plain_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.plain(texts(spark)).select("doc_id", "redacted", S.listed(F.col("spans")).alias("spans"))


@query
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.plain(table(spark, sf_dir, "pages"), "html", ["EMAIL", "IP_ADDRESS"])
    return done.select("page_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.size("spans").cast("long").alias("n_spans"))


@query
def exact_dup_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.plain_once(table(spark, sf_dir, "documents")).select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"))


@query
def apply_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("spans", S.detect(F.col("text"), ["EMAIL"]))
    return docs.select("doc_id", redaction.apply_mask(F.col("text"), F.col("spans"), "<{type}:{last4}>").alias("masked"))


@query
def apply_hash_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("spans", S.detect(F.col("text"), ["EMAIL"]))
    return docs.select("doc_id", redaction.apply_hash(F.col("text"), F.col("spans"), SALT).alias("hashed"))


@query
def entity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.span_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return numbered(found.select("doc_id", "start", F.substring(T.hmac_sha256(SALT, F.col("value")), 1, 8).alias("tag")))


@query
def format_last4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.span_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return numbered(found.select("doc_id", "start", T.render("[{type} {last4} {text} {nope}]", F.col("value"), F.col("type")).alias("shown")))


def _policy(name: str, which: policy.Policy, fixture: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = texts(spark) if fixture else table(spark, sf_dir, "documents").select("doc_id", "text")
        done = policy.redact(docs, which)
        entries = F.array_sort(F.transform(F.map_entries("relex_map"), lambda e: F.concat_ws("=", e["key"], e["value"])))
        return done.select("doc_id", "redacted", S.listed(F.col("spans")).alias("spans"), F.array_join(entries, " ").alias("relex"))

    QUERIES[name] = run


for _name, _which in (("default", policy.DEFAULT), ("strict", policy.STRICT), ("minimal", policy.MINIMAL)):
    _policy(f"redact_policy_{_name}", _which, False)
    _policy(f"redact_policy_{_name}_fixture", _which, True)
_policy(
    "card_policy_stage_order",
    policy.parse({"fields": {"ids": {"strategy": "regex", "format": "[ID]", "entity_types": ["CREDIT_CARD"]}, "cards": {"strategy": "regex", "format": "[CC-{last4}]", "entity_types": ["CREDIT_CARD"]}}}),
    True,
)
_policy("mask_and_hash_policies_do_nothing", policy.parse({"fields": {"a": {"strategy": "mask"}, "b": {"strategy": "hash"}}}), True)


@query
def policy_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = policy.listing(spark, [policy.DEFAULT, policy.MINIMAL, policy.STRICT])
    return listed.select("name", "version", F.array_join("fields", ",").alias("fields"))


@query
def relex_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", S.dedupe(S.detect(F.col("text"))))
    pairs = redaction.relex_pairs(F.col("text"), F.col("spans"))
    return docs.select("doc_id", S.splice_disjoint(F.col("text"), pairs).alias("relexed"))


@query
def relex_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.span_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    named = redaction.first_appearance_numbers(found)
    return named.select("doc_id", "type", "value", "placeholder", T.seed_signature(F.col("placeholder"), "s1").alias("signed"))


@query
def pipeline_typed_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = redaction.staged(docs, "text", S.empty(), F.lit(False), SALT)
    return done.select("doc_id", "digest", F.sha2("redacted", 256).alias("redacted_sha256"), F.size("fused").cast("long").alias("n_spans"))


@query
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages with a stub model that names every 'at', and is out for even documents."""
    model = F.transform(
        S.matches(F.col("text"), r"\bat\b"),
        lambda m: F.struct(m["start"], m["end"], F.lit("WORD"), F.lit(0.6)).cast(S.SPAN),
    )
    done = redaction.staged(texts(spark), "text", model, F.col("doc_id") % 2 == 0, SALT)
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in ("gate", "model", "fused", "fallback")]
    return done.select("doc_id", "digest", *counts, "used_fallback", "status", "redacted")


@query
def batch_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten documents: one audit row each."""
    docs = redaction.plain(table(spark, sf_dir, "documents").select("doc_id", "text"))
    batch = F.floor(F.col("doc_id") / 10).alias("request_id")
    return docs.groupBy(batch).agg(
        F.count("*").alias("items"), F.sum(F.length("text")).alias("text_chars"), F.sum(F.size("spans")).alias("n_spans")
    )


@query
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(chunks.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text", 500, 520))


@query
def chunk_ascii_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_text, with texts of ASCII alone cut in the JVM: only the others depend on bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ascii_only = F.octet_length("text") == F.length("text")
    quick = docs.where(ascii_only).select("doc_id", F.posexplode(chunks.ascii_chunks(F.col("text"), 500)).alias("chunk_ix", "chunk"))
    return numbered(quick.unionByName(chunks.chunk_table(docs.where(~ascii_only), "doc_id", "text", 500, 520)))


@query
def chunk_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunks.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text", 500, 2000)
    done = redaction.plain(pieces, "chunk")
    return numbered(done.select("doc_id", "chunk_ix", "redacted", S.listed(F.col("spans")).alias("spans")))


@query
def sse_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream of every document's chunks."""
    pieces = chunk_ascii_text(spark, sf_dir).withColumn("payload", F.to_json(F.struct("chunk_ix")))
    return chunks.event_lines(pieces, "doc_id", "payload", "chunk_ix")


@query
def sse_stream_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from chunk_text."""
    pieces = chunk_text(spark, sf_dir).withColumn("payload", F.to_json(F.struct("chunk_ix")))
    return chunks.event_lines(pieces, "doc_id", "payload", "chunk_ix")


@query
def streams_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.STREAMS, "id, body")
    return numbered(rows.select("id", chunks.stream_completed(F.col("body")).alias("done")))


# -- audit and evaluation ----------------------------------------------------------------------------------------------


@query
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.SPANS, "case_id, ord, start, `end`, type, confidence").select("type", F.col("confidence").cast("double"))
    return evaluation.span_summary(rows)


@query
def audit_summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "documents").select("source", F.explode(S.detect(F.col("text"))).alias("s"))
    return evaluation.span_summary(spans.select("source", "s.*"), "source")


@query
def pipeline_audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document one row for each type, and one that tells of a fallback."""
    done = redaction.staged(texts(spark), "text", S.empty(), F.col("doc_id") % 3 == 0, SALT)
    fallback = done.where("used_fallback").select("doc_id", F.lit("__used_fallback__").alias("type"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("confidence_avg"))
    spans = done.select("doc_id", F.explode("fused").alias("s")).select("doc_id", "s.*")
    return fallback.unionByName(evaluation.span_summary(spans, "doc_id"))


@query
def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(operations.retained(values(spark, X.AUDIT, "id, ts, policy"), "ts", "2024-02-01 00:00:00"))


@query
def audit_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.last_events(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), 100, "ts", "event_id")


@query
def audit_last_n_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.last_events(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), 3, "ts", "event_id", "user_id")


def _fixture_outcomes(spark: SparkSession) -> DataFrame:
    gold = values(spark, X.GOLD, "doc_id, start, `end`, type").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = detection.span_table(texts(spark), "doc_id", "text")
    return evaluation.outcomes(gold, found)


@query
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture_outcomes(spark)


@query
def eval_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_fixture_outcomes(spark))


@query
def eval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.format_string("%-12s %6.3f %6.3f %6.3f", "type", "precision", "recall", "f1")
    return evaluation.summary(_fixture_outcomes(spark)).select("type", row.alias("line"))


def _document_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What demonstration rules find, judged by what the rules find, over all documents."""
    gold = detection.span_table(table(spark, sf_dir, "documents"), "doc_id", "text", list(SIDE_RULES))
    _, demo, _ = _document_sides(spark, sf_dir)
    return evaluation.outcomes(gold, demo.withColumn("type", F.substring_index("span_id", "-", 1)))


@query
def eval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_outcomes(spark, sf_dir)


@query
def eval_documents_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(_document_outcomes(spark, sf_dir)))


@query
def bio_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged words of all conversations: capitals begin or go on with a name by their length, figures go on with a number."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")

    def tag(word: Column) -> Column:
        name = F.when(F.length(word) % 2 == 0, "B-NAME").otherwise("I-NAME")
        return F.when(word.rlike("^[A-Z]"), name).when(word.rlike("^[0-9]"), "I-NUM").otherwise("O")

    tokens = F.transform(S.matches(F.col("text"), "[A-Za-z0-9]+"), lambda w: F.struct(tag(w["value"]).alias("tag"), w["start"].alias("start"), w["end"].alias("end")))
    tagged = rows.select("id", F.explode(detection.bio_spans(tokens)).alias("s"))
    return numbered(tagged.select("id", "s.start", "s.end", "s.type"))


@query
def model_output_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers without offsets, for all documents: first places of the values that are there."""
    answers = [("person", "Anna", 0.9), ("word", "the", 0.8), ("place", "no such place", 0.7), ("mark", "@", 0.6)]
    found = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(v).alias("value"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(c).alias("score")) for a, v, c in answers))
    docs = table(spark, sf_dir, "documents")
    spans = docs.select("doc_id", F.explode(detection.normalize_model_output(F.col("text"), found)).alias("s"))
    return numbered(spans.select("doc_id", "s.start", "s.end", "s.type", F.round("s.confidence", 3).alias("confidence")))


@query
def audit_retention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from a day on; those whose time cannot be read stay."""
    events_ = table(spark, sf_dir, "events")
    written = F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("event_id"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return operations.retained(events_.select("event_id", written.alias("ts")), "ts", "2024-01-10 00:00:00")


@query
def disagreement_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, votes and alpha over all events."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("string").alias("unit_id"), F.col("user_id").alias("rater"), (F.col("value") > 50).alias("redacted"))
    return _rounded(agreement.report(rows.withColumn("kind", F.lit("hour"))))


@query
def labels_by_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.size(S.detect(F.col("text"))) > 0).alias("pii"))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("pii").alias("n_pii"))


@query
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def _corpus(spark: SparkSession, predictions: str) -> DataFrame:
    docs = values(spark, X.CORPUS, "doc_id, category, text")
    spans = values(spark, X.ANNOTATIONS, "doc_id, start, `end`, category").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "category"))).cast(corpus.LABELLED).alias("spans")
    )
    if predictions == "RULES":
        found = docs.select("doc_id", F.transform(S.detect(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("predictions"))
    else:
        rows = X.PREDICTIONS if predictions == "PREDICTIONS" else "('none', 0, 0)"
        one = F.collect_list(F.struct("start", "end")).alias("predictions")
        found = values(spark, rows, "doc_id, start, `end`").groupBy("doc_id").agg(one)
    joined = docs.join(spans, "doc_id").join(found, "doc_id", "left")
    return joined.withColumn("spans", corpus.normalized(F.col("text"), F.col("spans")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


for _which in ("RULES", "PREDICTIONS", "EMPTY"):
    QUERIES[f"rscore_per_doc_{_which.lower()}"] = lambda spark, sf_dir, which=_which: _rounded(scoring.scores(_corpus(spark, which)))


@query
def rscore_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus_ = _corpus(spark, "RULES")
    return _rounded(scoring.report(scoring.scores(corpus_), corpus_.select("doc_id", "category")))


@query
def rscore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what the rules find is mandatory, the demonstration profile predicts."""
    as_pairs = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("gold", S.dedupe(S.detect(F.col("text"))))
    spans = F.transform("gold", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("mandatory").alias("category")))
    docs = docs.withColumn("spans", spans).withColumn("predictions", as_pairs(detection.demo_spans(F.col("text"))))
    return _rounded(scoring.scores(docs))


#: What is mandatory, contextual and predicted where whole tables are scored.
SCORED = {"mandatory": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "contextual": r"[A-Z][a-z]*|[0-9]+", "predicted": r"[A-M][a-z]+ [a-z]+|[5-9]+|[N-P][a-z]+[^A-Z0-9@]{1,40}[A-Z]"}


def _scored(df: DataFrame, key: str, text: str) -> DataFrame:
    def found(kind: str) -> Column:
        # every address has the sign, and most texts have none
        return S.matches(F.col("text"), SCORED[kind], literal="@" if kind == "mandatory" else "", dense=kind != "mandatory")

    def own(kind: str) -> Column:
        return F.transform(found(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("category")))

    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    predicted = F.transform(found("predicted"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return docs.select("doc_id", "text", F.concat(own("mandatory"), own("contextual")).alias("spans"), predicted.alias("predictions"))


@query
def rscore_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all pages: mail addresses are mandatory, capitalised words and numbers contextual; markup has nested delimiters."""
    return _rounded(scoring.scores(_scored(table(spark, sf_dir, "pages"), "page_id", "html")))


@query
def rscore_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the same patterns."""
    return _rounded(scoring.scores(_scored(table(spark, sf_dir, "documents"), "doc_id", "text")))


@query
def rscore_report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and quantiles of the scores of all documents, over all and by source."""
    docs = table(spark, sf_dir, "documents")
    score = scoring.scores(_scored(docs, "doc_id", "text"))
    return _rounded(scoring.report(score, docs.select("doc_id", F.col("source").alias("category"))))


@query
def corpus_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for own in corpus.STRUCTURES.values() for c in own]
    return spark.createDataFrame([(c,) for c in names], "category string").withColumn("structure", corpus.structure(F.col("category")))


@query
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = [("User bob logged in from 10.1.1.1", ["bob", "10.1.1.1"]), ("export KEY=abc", ["abc"]), ("see a@b.org", ["a@b.org"])]
    rows = corpus.from_templates(spark, templates, 10)
    return rows.select("id", "text", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ").alias("spans"))


@query
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quota(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "doc_id", 5)


@query
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


def ratings(spark: SparkSession) -> DataFrame:
    return values(spark, X.RATINGS, "unit_id, kind, rater, redacted")


@query
def agreement_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.pairwise(ratings(spark)))


@query
def agreement_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.by_kind(ratings(spark)))


@query
def alpha_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.alpha(ratings(spark)))


@query
def alpha_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.alpha_by_kind(ratings(spark)))


@query
def alpha_pooled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = F.when(F.col("kind").startswith("gap_"), "gap").otherwise(F.col("kind"))
    return _rounded(agreement.alpha_by_kind(ratings(spark).withColumn("kind", pooled)))


@query
def disagreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.report(ratings(spark)))


@query
def agreement_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users rate the hour of their events: large scale input for the same statistics."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.date_trunc("hour", "ts").cast("string").alias("unit_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("rater"), (F.col("value") > 50).alias("redacted"))
    return _rounded(agreement.by_kind(rows).join(agreement.alpha_by_kind(rows), "kind"))


@query
def wilson_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang")
    counted = by.agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    low, high = agreement.wilson(F.col("k"), F.col("n"))
    return _rounded(counted.select("lang", "k", "n", low.alias("low"), high.alias("high")))


@query
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.average_rank(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "rank").select("p_partkey", "rank")


@query
def spearman_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho, p = agreement.spearman(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), "x", "y")
    return spark.createDataFrame([(round(rho, 9), round(p, 6))], "rho double, p double")


# -- operations --------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query
def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = operations.fixed_window(events(spark, sf_dir), "user_id", "ts", "event_id", limit=1)
    return numbered(limited.select("event_id", "user_id", "place", "accepted", "retry_after"))


@query
def rate_limit_day_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = operations.fixed_window(events(spark, sf_dir), "user_id", "ts", "event_id", limit=2, seconds=86_400)
    return limited.groupBy("window_start").agg(F.count("*").alias("requests"), F.count_if(~F.col("accepted")).alias("rejected"))


@query
def owner_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", operations.owner_token(F.col("user_id").cast("string")).alias("owner"))


@query
def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = values(spark, "('k1', array('redact', 'detect')), ('k2', array('jobs'))", "key, scopes")
    asked = values(spark, "(1, 'k1', 'redact'), (2, 'k2', 'redact'), (3, 'k3', 'jobs'), (4, 'k2', 'jobs')", "id, key, scope")
    joined = asked.join(keys, "key", "left")
    return numbered(joined.select("id", F.coalesce(F.array_contains("scopes", F.col("scope")), F.lit(False)).alias("allowed")))


@query
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.CALLERS, "id, given, chars, has_policy, has_types, staged")
    name = operations.request_id(F.col("given"), F.lit("generated"))
    status = operations.request_status(F.col("chars"), F.col("chars"), F.col("has_policy"), F.col("has_types"), F.col("staged"))
    return numbered(rows.select("id", name.alias("request_id"), status.alias("status")))


@query
def oversized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    status = operations.request_status(n, n * 100, F.lit(False), F.lit(False), F.lit(False))
    return table(spark, sf_dir, "documents").groupBy(status.cast("long").alias("status")).agg(F.count("*").alias("n"))


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
    found = evaluation.histogram(events(spark, sf_dir), "value", bounds, "event_type")
    return found.select("event_type", F.when(F.col("le") > 1e300, "+Inf").otherwise(F.format_string("%.1f", "le")).alias("le"), "n")


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    wanted = {f"p{int(q * 100)}": q for q in (0.5, 0.9, 0.95, 0.99)}
    found = evaluation.quantiles(rows, ["event_type"], "value", wanted).select(F.col("event_type").alias("_type"), *(F.round(c, 6).alias(c) for c in wanted))
    sums = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))
    return sums.join(found, F.col("event_type").eqNullSafe(F.col("_type")), "left").drop("_type")


@query
def exclusive_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = events(spark, sf_dir).select(F.to_date("ts").cast("string").alias("day"), "value")
    found = evaluation.quantiles(by_day, ["day"], "value", {"p95": 0.95, "p99": 0.99}, exclusive=True)
    return found.select("day", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query
def bucket_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
    counted = evaluation.histogram(events(spark, sf_dir), "value", bounds, "event_type")
    return evaluation.bucket_quantile(counted, 0.99, "event_type").select("event_type", F.round("quantile", 6).alias("p99"))


@query
def error_ratio_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.window(F.col("ts").cast("timestamp"), "6 hours", "3 hours")
    bad = F.count_if(F.col("event_type") == "error")
    counted = events(spark, sf_dir).groupBy(window).agg(bad.alias("errors"), F.count("*").alias("all"))
    ratio = F.col("errors") / F.greatest(F.col("all"), F.lit(1))
    return counted.select(F.unix_seconds("window.start").alias("window_start"), "errors", F.round(ratio, 9).alias("ratio"), (ratio > 0.01).alias("alert"))


@query
def increase_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts").cast("string").alias("day")
    return events(spark, sf_dir).groupBy(day, "event_type").agg(F.count("*").alias("n")).withColumn("alert", F.col("n") > 60)


@query
def heartbeat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's events that are at most four hours apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.when(at - F.lag(at).over(order) < 4 * 3_600_000_000, 0).otherwise(1)
    run = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    beats = events(spark, sf_dir).withColumn("fresh", fresh).withColumn("session", run)
    return beats.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("beats"))


@query
def worker_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.WORKERS, "worker, active, most")
    total = lambda c: F.sum(F.greatest(F.lit(0), F.col(c).try_cast("int"))).alias(c)
    return numbered(rows.where(F.col("active").try_cast("int").isNotNull() & F.col("most").try_cast("int").isNotNull()).agg(total("active"), total("most")))


@query
def job_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.job_states(values(spark, X.JOBS, "job_id, seq, event"))


@query
def jobs_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: O is running; in flight by customer and in all."""
    orders = table(spark, sf_dir, "orders").withColumn("live", F.col("o_orderstatus") == "O")
    return orders.rollup("o_custkey").agg(F.count_if("live").alias("in_flight")).select(F.coalesce("o_custkey", F.lit(-1)).alias("owner"), "in_flight")


@query
def oldest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return orders.agg(F.min("o_orderdate").alias("oldest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "('a', 'running', '700'), ('b', 'running', '701'), ('c', 'queued', 'bad'), ('d', 'done', '1')", "job_id, status, updated_at")
    return operations.stale(rows, 1000).select("job_id", F.lit("failed").alias("status"), F.lit("job lease expired").alias("error"))


@query
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = spark.range(1, 9).select(F.col("id").alias("try"))
    dead = F.col("try") >= operations.MOST_TRIES
    return tries.select("try", F.when(~dead, operations.retry_delay(F.col("try"))).alias("delay"), dead.alias("dead_letter"))


@query
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(operations.idempotent(values(spark, X.REQUESTS, "key, seq, fingerprint")))


@query
def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's minute is the key, the event type what is asked."""
    keyed = events(spark, sf_dir).select(F.concat_ws("/", "user_id", F.date_trunc("minute", "ts").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("fingerprint"))
    return operations.idempotent(keyed).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.CALLS, "model, seq, at, ok")
    rows = rows.select("model", F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "ok")
    return numbered(operations.breaker_replay(rows))


@query
def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.ADMISSIONS, "seq, owner, change").withColumn("seq", F.col("seq").cast("long"))
    return operations.admission(rows, most=4, most_per_owner=2)


@query
def saturation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that scaling and alerts look at, from an hour's events."""
    hour = F.date_trunc("hour", "ts")
    counted = events(spark, sf_dir).groupBy(hour.cast("string").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return counted.select("hour", (F.col("n") / 20 > 0.9).alias("pool"), (F.col("users") > 10).alias("queue"), (F.col("n") == 0).alias("no_workers"))


@query
def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_status_table(values(spark, X.STATUS_LINES, "value"))
    return rows.where(F.col("status").isin(*tables.STATUSES)).groupBy("status").agg(F.count("*").alias("n"))


@query
def model_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_manifest(values(spark, X.MANIFEST_LINES, "value"))


# -- records and models ------------------------------------------------------------------------------------------------


@query
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", records.cache_key(F.col("text"), entity_types=["EMAIL"], salt=SALT).alias("key"))


@query
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark).select("doc_id", records.fingerprint(F.col("text"), staged=True).alias("fingerprint"))


@query
def sealed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sealed and checked: as they are, changed, and with another key."""
    plain = values(spark, X.AUDIT, "id, ts, policy").withColumn("event", F.to_json(F.struct("ts", "policy")))
    done = plain.select("id", records.sealed(F.col("event"), SALT).alias("event"))
    changed = F.regexp_replace("event", '"policy":"."', '"policy":"z"')
    return numbered(
        done.select(
            "id",
            records.intact(F.col("event"), SALT).alias("intact"),
            records.intact(changed, SALT).alias("changed"),
            records.intact(F.col("event"), "other").alias("other_key"),
        )
    )


@query
def cache_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(
        spark,
        """(1, '{"schema_version": 1, "response": {"a": 1}}'), (2, '{"schema_version": 2, "response": {"a": 1}}'), (3, 'not json'), (4, null),
           (5, '{"schema_version": 1, "response": "text"}'), (6, '[1]')""",
        "id, raw",
    )
    return numbered(rows.select("id", records.opened_envelope(F.col("raw")).alias("response")))


@query
def encrypted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = b"0123456789abcdef", b"fedcba9876543210"
    sent = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", records.encrypted(F.col("text"), key).alias("sent"))
    same = records.decrypted(F.col("sent"), key) == F.col("text")
    return sent.select("conv_id", "turn", same.alias("same"), records.decrypted(F.col("sent"), other).isNull().alias("lost"))


@query
def model_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model in the staged pipeline, over all documents."""
    detect = models.detector(lambda: models.Words({"the": ("WORD", 0.9), "and": ("WORD", 0.4)}))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("found", detect(F.col("text")))
    done = redaction.staged(docs, "text", F.col("found"), F.lit(False), SALT)
    return done.select("doc_id", F.size("model").cast("long").alias("n_model"), F.size("fused").cast("long").alias("n_fused"), F.sha2("redacted", 256).alias("redacted_sha256"))


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = values(spark, X.TRIES, "job_id, tries, ok, decoded, error, at")
    return numbered(operations.dead_letters(tries, most=3))


@query
def idempotency_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = values(spark, X.LEASES, "key, seq, at, event, fingerprint, token")
    return numbered(operations.lease_log(log, ttl=100))


@query
def shared_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = values(spark, X.PROBES, "model, seq, at, event, probe")
    return numbered(operations.shared_breaker(log))


@query
def benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for hot and cold caches, over all documents."""
    modes = F.explode(F.array(F.lit("cache-hot"), F.lit("cache-cold"))).alias("mode")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", modes)
    return rows.select("doc_id", "mode", F.sha2(T.benchmark_text(F.col("mode"), F.col("text"), F.col("doc_id")), 256).alias("digest"))


@query
def pipeline_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "(1, array(1.5D, 5D)), (2, array()), (3, array(4.25D, null))", "id, ms")
    return numbered(rows.select("id", redaction.total_latency(F.col("ms").cast("array<double>")).alias("total_ms")))


@query
def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {
        "own": policy.resolve({"version": "7"}, None),
        "own without version": policy.resolve({}, None),
        "types": policy.resolve(None, ["EMAIL"]),
        "default": policy.resolve(None, None),
    }
    return spark.createDataFrame([(k, policy.version_of(p)) for k, p in asked.items()], "request string, version string")


@query
def converted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, X.MASKED, "id, language, source_text, privacy_mask")
    found = corpus.converted(rows, "c_")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.concat_ws("-", s["start"], s["end"]), s["type"])), " ")
    return found.select("doc_id", listed.alias("spans"))
