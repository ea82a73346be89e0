"""Scoring corpora, annotations, predictions and fixtures as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwork.functions import spans as S
from veilwork.functions import text as T
from veilwork.functions.rules import DATASET_LABELS, OTHER_TYPE

DOCUMENT = "id string, text string, category string, genre string, source string"
LABELLED = "array<struct<start:int,end:int,category:string>>"
ANNOTATION = f"doc_id string, spans {LABELLED}, meta map<string,string>, text string"
PREDICTION = "doc_id string, predictions array<struct<start:int,end:int>>"
FIXTURE = "text string, entities array<struct<start:int,end:int,type:string,confidence:double>>"

#: Document categories by how their texts are built.
STRUCTURES = {
    "unstructured": ("emails", "medical", "legal", "academic", "financial", "government", "operations"),
    "structured": ("code", "files", "logs", "terminal"),
}


def structure(category: Column) -> Column:
    kinds = F.when(category.isin(*STRUCTURES["structured"]), "structured")
    return kinds.when(category.isin(*STRUCTURES["unstructured"]), "unstructured")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their structure; blank lines are none, an unknown category stops the query."""
    df = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    df = df.withColumn("genre", F.coalesce("genre", F.lit(""))).withColumn("source", F.coalesce("source", F.lit("synthetic")))
    known = structure(F.col("category"))
    stop = F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("none"))))
    return df.withColumn("structure", F.when(known.isNull(), stop).otherwise(known))


def write_documents(df: DataFrame, path: str) -> None:
    df.select("id", "text", "category", "genre", "source").write.json(path)


def normalized(text: Column, spans: Column) -> Column:
    """Spans cut at line ends, each once, sorted; one outside of the text stops the query."""
    bad = F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] < s["start"]) | (s["end"] > F.length(text)))
    cut = F.array_sort(F.array_distinct(S.split_on_newlines(text, spans, LABELLED)))
    return F.when(bad, F.raise_error(F.lit("span out of range"))).otherwise(cut)


def read_annotations(spark: SparkSession, path: str, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, spans, meta: spans are normalized against the document's text, or their own if it has none."""
    df = spark.read.schema(ANNOTATION).option("mode", "FAILFAST").json(path)
    if documents is not None:
        texts = documents.select(F.col("id").alias("doc_id"), F.col("text").alias("_text"))
        df = df.join(texts, "doc_id", "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", normalized(text, F.coalesce("spans", S.empty(LABELLED))).alias("spans"), "meta")


def write_annotations(df: DataFrame, path: str) -> None:
    df.select("doc_id", "spans", "meta").write.json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE).option("mode", "FAILFAST").json(path)


def quota(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def from_templates(spark: SparkSession, templates: list[tuple[str, list[str]]], n: int) -> DataFrame:
    """n synthetic rows: templates in turn, and the spans of the values in them (their first places)."""
    rows = [(i, t, values) for i, (t, values) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, text string, entities array<string>")
    numbered = spark.range(n).withColumn("template", (F.col("id") % len(templates)).cast("int"))
    spans = F.transform(
        "entities",
        lambda v: F.struct((F.instr(F.col("text"), v) - 1).alias("start"), (F.instr(F.col("text"), v) - 1 + F.length(v)).alias("end")),
    )
    return numbered.join(table, "template").select("id", "text", spans.alias("spans"))


def converted(rows: DataFrame, prefix: str) -> DataFrame:
    """doc_id, text, category and typed spans of masked rows (id, language, source_text, privacy_mask).

    Rows in other languages, without a mask or without text are dropped; of rows with one id the first in order of text,
    and of these the first in order of its mask, stays.
    """
    text = T.normalize_text(F.col("source_text"))
    good = rows.where((F.col("language") == "en") & (F.size("privacy_mask") > 0)).withColumn("text", text).where("text <> ''")
    one = good.groupBy("id").agg(F.min(F.struct("text", "privacy_mask")).alias("r")).select("id", "r.*")
    kind = lambda m: F.coalesce(T.lookup(DATASET_LABELS, m["label"]), F.lit(OTHER_TYPE))
    typed = F.transform("privacy_mask", lambda m: F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), kind(m).alias("type")))
    labels = F.transform("privacy_mask", lambda m: m["label"])
    return one.select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("doc_id"), "text", T.category(F.col("text"), labels).alias("category"), F.array_sort(typed).alias("spans")
    )
