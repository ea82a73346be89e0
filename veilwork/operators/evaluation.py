"""Exact-span precision, recall and F1; audit summaries; percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators.ranks import numbered
from veilwork.sources.shared import stored


def outcomes(gold: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn of each type; both sides (doc_id, start, end, type) are sets."""
    keys = ["doc_id", "start", "end", "type"]
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = found.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, keys, "full")
    return both.groupBy("type").agg(
        F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_g").isNull()).alias("fp"),
        F.count_if(F.col("_p").isNull()).alias("fn"),
    )


def summary(outcome: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each type and, over all counts, OVERALL; 0 where nothing can be divided."""
    rolled = outcome.rollup("type").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    rolled = rolled.withColumn("type", F.coalesce("type", F.lit("OVERALL")))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = rolled.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def span_summary(spans: DataFrame, *by: str) -> DataFrame:
    """Count and mean confidence of each type; means are rounded half to even."""
    return spans.groupBy(*by, "type").agg(
        F.count("*").alias("count"), F.bround(F.avg("confidence"), 3).alias("confidence_avg")
    )


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative buckets: how many values are at most each bound, and all at +Inf, by the given columns.

    One row per group first, then one per bucket: rows are not multiplied by buckets.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*by).agg(*counts, F.count(value).alias("all"))
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return one.select(*by, F.explode(F.array(*entries)).alias("bucket")).select(*by, "bucket.le", "bucket.n")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], exclusive: bool = False) -> DataFrame:
    """Exact quantiles of each group, linear between the two values at whose ranks each lies; nulls are no values.

    The p-quantile of n values lies at rank 1 + p (n - 1), or by the exclusive method at p (n + 1), on the line through the first or last two values where that lies beyond.
    All groups are put in one order by range parts, so a group is a stretch of places, however large it is, and no task
    holds more than a part; of each group only the few rows at the wanted places meet.
    """
    rows = stored(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")))
    placed = numbered(rows, [*(F.col(c) for c in by), F.col("_v")], "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    n, entries = F.col("_n"), []
    for name, q in wanted.items():
        at = n * q + q if exclusive else 1 + (n - 1) * q
        low = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(n - 1, F.lit(1)))
        for side, rank in (("low", low), ("high", F.least(low + 1, n))):
            entries.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.col("_first") + rank - 1).alias("at"), (at - low).alias("weight")))
    asked = groups.select(*by, F.explode(F.array(*entries)).alias("_asked"))
    found = asked.join(placed.select("_at", "_v"), F.col("_asked.at") == F.col("_at"))
    of = lambda name, side: F.max(F.when((F.col("_asked.name") == name) & (F.col("_asked.side") == side), F.col("_v")))
    weight = lambda name: F.max(F.when(F.col("_asked.name") == name, F.col("_asked.weight")))
    # 0 times an infinite difference would be no number
    between = lambda m: F.when(weight(m) == 0, of(m, "low")).otherwise(of(m, "low") + weight(m) * (of(m, "high") - of(m, "low")))
    return found.groupBy(*by).agg(*(between(name).alias(name) for name in wanted))


def bucket_quantile(counted: DataFrame, q: float, *by: str) -> DataFrame:
    """A quantile from cumulative buckets (le, n), linear within its bucket; the last bound if it lies beyond."""
    order = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    told = counted.select(*by, "le", "n", F.lag("n", 1, 0).over(order).alias("below"), F.lag("le", 1, 0.0).over(order).alias("low"), total.alias("total"))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.lit(q) * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") > 1e300, F.col("low")).otherwise(inside)
    return told.where(F.col("n") >= F.lit(q) * F.col("total")).groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))
