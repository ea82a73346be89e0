"""How far raters agree: tables of ratings (unit_id, kind, rater, redacted)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def units(ratings: DataFrame, *by: str) -> DataFrame:
    """m votes and k of them to redact, for each unit."""
    vote = F.coalesce(F.col("redacted").cast("int"), F.lit(0))
    return ratings.groupBy(*by, "unit_id").agg(F.count("*").alias("m"), F.sum(vote).alias("k"))


def _disagreement() -> Column:
    pairs = F.col("m") * (F.col("m") - 1) / 2
    return F.when(F.col("m") >= 2, F.col("k") * (F.col("m") - F.col("k")) / pairs)


def pairwise(ratings: DataFrame) -> DataFrame:
    """Mean share of rater pairs that disagree, over units with two votes or more; 0 without any."""
    return units(ratings).agg(F.coalesce(F.avg(_disagreement()), F.lit(0.0)).alias("disagreement"))


def by_kind(ratings: DataFrame) -> DataFrame:
    rate = F.when(F.col("m") >= 2, F.col("k") / F.col("m"))
    return (
        units(ratings, "kind")
        .groupBy("kind")
        .agg(
            F.count_if(F.col("m") >= 2).cast("double").alias("n_qualifying"),
            F.coalesce(F.avg(_disagreement()), F.lit(0.0)).alias("disagreement"),
            F.coalesce(F.avg(rate), F.lit(0.0)).alias("redaction_rate"),
        )
    )


def _alpha(n: Column, n1: Column, within: Column) -> Column:
    """1 - observed / expected disagreement; one-sided votes leave nothing to expect."""
    observed = within / n
    expected = 2 * (n - n1) * n1 / (n * (n - 1))
    return F.when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / expected)


def _alpha_parts() -> list[Column]:
    within = F.when(F.col("m") >= 2, 2 * (F.col("m") - F.col("k")) * F.col("k") / (F.col("m") - 1))
    return [
        F.sum("m").alias("n"),  # votes on units with one vote count here
        F.sum("k").alias("n1"),
        F.coalesce(F.sum(within), F.lit(0.0)).alias("within"),
        F.count_if(F.col("m") >= 2).alias("qualifying"),
    ]


def alpha(ratings: DataFrame) -> DataFrame:
    parts = units(ratings).agg(*_alpha_parts())
    value = F.when(F.coalesce("n", F.lit(0)) < 2, 1.0).otherwise(_alpha(F.col("n"), F.col("n1"), F.col("within")))
    return parts.select(value.alias("alpha"))


def alpha_by_kind(ratings: DataFrame) -> DataFrame:
    parts = units(ratings, "kind").groupBy("kind").agg(*_alpha_parts())
    none = (F.col("n") < 2) | (F.col("qualifying") == 0)
    return parts.select("kind", F.when(none, 0.0).otherwise(_alpha(F.col("n"), F.col("n1"), F.col("within"))).alias("alpha"))


def report(ratings: DataFrame) -> DataFrame:
    """Qualifying units, votes of both sides, and alpha, in one row."""
    parts = units(ratings).agg(*_alpha_parts())
    n, n1 = F.coalesce("n", F.lit(0)), F.coalesce("n1", F.lit(0))
    value = F.when(n < 2, 1.0).otherwise(_alpha(F.col("n"), F.col("n1"), F.col("within")))
    return parts.select(
        F.col("qualifying").cast("long").alias("n_qualifying_units"),
        n1.cast("long").alias("n_redact_votes"),
        (n - n1).cast("long").alias("n_no_redact_votes"),
        value.alias("global_alpha"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion; (0, 1) without observations."""
    share, z2 = k / n, z * z
    denominator = 1 + z2 / n
    centre = (share + z2 / (2 * n)) / denominator
    half = z / denominator * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n <= 0, 0.0).otherwise(low), F.when(n <= 0, 1.0).otherwise(high)


RANK_PARTS = 64


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the 1-based rank of value; ties share the mean of theirs. Rows without a value have no rank and go.

    A rank is the count of smaller values and of half the ties. Ties meet in one row first. Then values are dealt by
    approximate quantiles: what stands below each part is a bounded number of sums, and within a part a window counts
    on. No task holds more than a part.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    shares = [i / RANK_PARTS for i in range(1, RANK_PARTS)]
    bounds = sorted(set(sizes.agg(F.percentile_approx(value, shares)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value))) if bounds else F.lit(0)
    parted = sizes.withColumn("_part", part)
    below, total = {}, 0
    for r in sorted(parted.groupBy("_part").agg(F.sum("_n").alias("n")).collect()):
        below[r["_part"]], total = total, total + r["n"]
    offset = F.create_map(*(F.lit(x) for pair in below.items() for x in pair))[F.col("_part")] if below else F.lit(0)
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = parted.select(value, (offset + within - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranked, value)


def spearman(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Rank correlation without correction for ties, and its two-sided p from the normal distribution."""
    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    n, d2 = ranked.agg(F.count("*"), F.sum(F.pow(F.col("_rx") - F.col("_ry"), 2))).first()
    if n < 3:
        raise ValueError("spearman needs three observations")
    rho = 1 - 6 * d2 / (n * (n * n - 1))
    if abs(rho) >= 0.999999:
        return rho, 0.0
    return rho, 2 * (1 - NormalDist().cdf(abs(rho * math.sqrt((n - 2) / (1 - rho * rho)))))
