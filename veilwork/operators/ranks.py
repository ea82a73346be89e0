"""Numbers of rows in a total order, without one task that sees them all.

Rows are dealt by range and sorted within each part; a part's rows then know
their place in it, and what stands before a part is a sum over parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.sources.shared import stored

#: Rows of a part, on average, where there are more parts than the session's shuffles have.
PART_ROWS = 500_000
#: monotonically_increasing_id() has the partition above so many bits, and the row's place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the given order, from 1 on, as a long.

    Rows that are equal in the order get places next to each other. df is read
    three times (rows, range bounds, rows with places), so it should be a table.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PLACE_BITS).alias("_part")
    placed = placed.withColumn("_part", part)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_place") - F.shiftleft(F.col("_part"), PLACE_BITS) + 1
    ranked = placed.join(offsets, "_part")
    return ranked.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + within).alias(name))
