"""Unions, gaps, differences and coverage of intervals, as sweeps by document.

Tables have doc_id, start, end (exclusive). Starts, ends and the places asked
about are one stream, sorted within each document, and windows carry along what
has been passed: how many characters are covered, how far spans reach, how many
are open. So the work is that of a sort, however many spans meet, and no pair of
spans is ever formed. All keys are documents: a document's spans meet in one
task, whole documents spread over all tasks.

Null ids are a document of their own; spans with a null end meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def union(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Disjoint runs; what touches is one run. Spans are cut to the text first; texts has doc_id and length."""
    cut = spans.join(texts, "doc_id").select(
        "doc_id",
        F.greatest(F.lit(0), F.least("start", "length")).alias("start"),
        F.greatest(F.lit(0), F.least("end", "length")).alias("end"),
    )
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.where("start < end").withColumn("reach", F.max("end").over(before))
    fresh = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)
    grouped = marked.withColumn("run", F.sum(fresh).over(so_far)).groupBy("doc_id", "run")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def gaps(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """What the runs leave of each text, both ends included."""
    ends = texts.select("doc_id", F.col("length").alias("start"), F.col("length").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    walked = runs.unionByName(ends).withColumn("from", F.lag("end", 1, 0).over(order))
    return walked.where(F.col("from") < F.col("start")).select("doc_id", F.col("from").alias("start"), F.col("start").alias("end"))


def _so_far(*order: str | Column, by: tuple[str, ...] = ("doc_id",), last: int = 0) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def difference(runs: DataFrame, others: DataFrame) -> DataFrame:
    """What of the runs lies outside of the others. Both sides may overlap themselves; runs that touch stay apart."""
    ends = lambda df, kind: df.where("start < end").select(
        "doc_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e"), F.lit(kind).alias("kind")
    )
    marks = ends(runs, "run").unionByName(ends(others, "other")).select("doc_id", "e.at", "e.step", "kind")
    steps = marks.groupBy("doc_id", "at").agg(
        F.sum(F.when(F.col("kind") == "run", F.col("step")).otherwise(0)).alias("run"),
        F.sum(F.when(F.col("kind") == "other", F.col("step")).otherwise(0)).alias("other"),
        F.max(F.col("kind") == "run").alias("cuts"),
    )
    open_ = _so_far("at")
    free = (F.sum("run").over(open_) > 0) & (F.sum("other").over(open_) == 0)
    told = steps.withColumn("free", free).withColumn("next", F.lead("at").over(Window.partitionBy("doc_id").orderBy("at")))
    # pieces that only a border of the others parts, which hold nothing there, are one
    fresh = F.when(F.coalesce(~F.lag("free").over(Window.partitionBy("doc_id").orderBy("at")), F.lit(True)) | F.col("cuts"), 1).otherwise(0)
    pieces = told.withColumn("fresh", fresh).withColumn("piece", F.sum("fresh").over(open_)).where("free")
    return pieces.groupBy("doc_id", "piece").agg(F.min("at").alias("start"), F.max("next").alias("end")).drop("piece")


def coverage(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """spans (doc_id, span_id, start, end) with the share of their characters that lies in the runs, which are disjoint.

    Covered characters before a place are those of all runs that have begun, less what the last of them has to go.
    """
    none = F.lit(None)
    begun = runs.where("start < end").select("doc_id", F.col("start").alias("at"), F.col("end").alias("reach"), (F.col("end") - F.col("start")).alias("size"), none.cast("string").alias("span_id"), none.alias("side"))
    asked = spans.select("doc_id", "span_id", "start", "end", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("side"))
    asked = asked.select("doc_id", F.when(F.col("side") == "start", F.col("start")).otherwise(F.col("end")).alias("at"), none.alias("reach"), F.lit(0).alias("size"), "span_id", "side", "start", "end")
    order = _so_far("at")
    points = asked.unionByName(begun, allowMissingColumns=True)
    to_go = F.greatest(F.coalesce(F.max("reach").over(order), F.col("at")) - F.col("at"), F.lit(0))
    points = points.withColumn("before", F.sum("size").over(order) - to_go).where("side is not null")
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("before")))
    summed = points.groupBy("doc_id", "span_id", "start", "end").agg((side("end") - side("start")).alias("hit"))
    total = F.col("end") - F.col("start")
    return summed.withColumn("coverage", F.when(total > 0, F.col("hit") / total).otherwise(0.0)).drop("hit")


def _met(spans: DataFrame, others: DataFrame) -> DataFrame:
    """spans with _met: whether some other one begins before a span's end and reaches beyond its start."""
    row = F.struct(*(F.col(f"`{c}`") for c in spans.columns))
    asked = spans.select(F.col("doc_id").alias("_doc"), F.col("end").alias("_at"), F.lit(0).alias("_late"), F.lit(None).alias("_reach"), row.alias("_row"))
    begun = others.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_at"), F.lit(1).alias("_late"), F.col("end").alias("_reach"))
    points = asked.unionByName(begun, allowMissingColumns=True)
    # of what begins at a span's end nothing counts, so spans come first
    reach = F.max("_reach").over(_so_far("_at", "_late", by=("_doc",)))
    met = F.coalesce(reach > F.col("_row.start"), F.lit(False)) & F.col("_doc").isNotNull() & F.col("_at").isNotNull()
    told = points.withColumn("_met", met).where("_late = 0")
    return told.select(*(F.col("_row").getField(c).alias(c) for c in spans.columns), "_met")


def touched(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans that some other one overlaps."""
    return _met(spans, others).where("_met").drop("_met")


def untouched(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans that no other one overlaps."""
    return _met(spans, others).where("not _met").drop("_met")


def holding(spans: DataFrame, others: DataFrame) -> DataFrame:
    """spans with _holds: whether some other one lies whole inside; ends may coincide."""
    row = F.struct(*(F.col(f"`{c}`") for c in spans.columns))
    asked = spans.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_at"), F.lit(1).alias("_late"), F.lit(None).alias("_end"), row.alias("_row"))
    begun = others.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_at"), F.lit(0).alias("_late"), F.col("end").alias("_end"))
    points = asked.unionByName(begun, allowMissingColumns=True)
    # from the end of the text on: of all that begins at or behind a span's start, the least end
    least = F.min("_end").over(_so_far(F.col("_at").desc(), "_late", by=("_doc",)))
    holds = F.coalesce(least <= F.col("_row.end"), F.lit(False)) & F.col("_doc").isNotNull() & F.col("_at").isNotNull()
    told = points.withColumn("_holds", holds).where("_late = 1")
    return told.select(*(F.col("_row").getField(c).alias(c) for c in spans.columns), "_holds")
