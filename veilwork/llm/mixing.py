"""Temperature mixing of sources, in DataFrame expressions only.

A source's weight is its share of all tokens to the power of an exponent. The
exponent is bisected until the flattest mix is found that keeps a target: at
most a given entropy, or at most a given number of repetitions of any source.
Weights and budget give each source a number of tokens. It is realised in
epochs, each a permutation of the source's blocks: all blocks in every full
epoch, and in the last one whole blocks of the permutation up to the budget,
then rows of the block that crosses it, in an order of their own.

The hashed order of blocks makes the choice a comparison: of a source only the
last whole block and the one that crosses the budget are told to the rows, in a
table with a row for each source, and rows decide on their own. Just those of
crossing blocks are put in an order, a block to a task; the number of blocks
follows the rows, so its size does not. No other row is shuffled. What the
driver gets are sums, and their number does not depend on the number of sources.

Edge cases: words are counted as tokens, a null text has none; a null source
counts as the source with the empty name; sources without tokens have weight 0
and are taken once; rows without tokens come with their block. Repeated rows are
rows of their own; of rows that share id, source and word count the hashes of
their texts and of their other columns decide the order. An empty table gives an
empty table; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from veilwork.llm.common import WORD, stored, unwrapped, wrapped

#: Blocks of a source at least, rows of a source's block at most (on average), levels of bisection that one pass over the
#: sources settles, and passes.
BLOCKS, BLOCK_ROWS, LEVELS, PASSES = 1024, 500_000, 5, 6
SEED = "mix"


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for; budget is in tokens, None: every source whole at least once."""

    repetition: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_table(df: DataFrame) -> DataFrame:
    """source, tokens and rows of df (source, n_tokens)."""
    return stored(df.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))


def _figures(sources: DataFrame, total: int, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """Of each exponent the mix's entropy in nats, and the largest and smallest ratio of weight to share."""
    share = F.col("tokens") / F.lit(float(total))
    rows = sources.where("tokens > 0").select(share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.pow("p", F.col("a"))
    sums = rows.groupBy("a").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.log("p")).alias("l"),
        F.max(F.pow("p", F.col("a") - 1)).alias("most"),
        F.min(F.pow("p", F.col("a") - 1)).alias("least"),
    )
    return {r["a"]: (math.log(r["z"]) - r["a"] * r["l"] / r["z"], r["most"] / r["z"], r["least"] / r["z"]) for r in sums.collect()}


def bisect_exponent(sources: DataFrame, total: int, target: Target) -> float:
    """The smallest exponent in [0, 1] that keeps the target, 1 if none does; to six places, rounded up."""

    def keeps(figures: tuple[float, float, float]) -> bool:
        entropy, most, least = figures
        if target.entropy is not None and entropy > target.entropy + 1e-12:
            return False
        if target.repetition is None:
            return True
        repeated = most / least if target.budget is None else most * target.budget / total
        return repeated <= target.repetition * (1 + 1e-12)

    low, high = 0.0, 1.0  # high keeps the target, or nothing does
    ends = _figures(sources, total, [low])
    if keeps(ends[low]):
        return 0.0
    for _ in range(PASSES):
        n = 2**LEVELS
        inner = [low + (high - low) * k / n for k in range(1, n)]
        figures = _figures(sources, total, inner)
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if keeps(figures[inner[mid - 1]]) else (mid, b)
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return min(1.0, math.ceil(high * 1e6 - 1e-3) / 1e6)


def plan_table(sources: DataFrame, target: Target) -> DataFrame:
    """source, tokens, weight, target_tokens, and how they are met: epochs in full, and the rest of tokens."""
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        exponent, z, least = 1.0, 1.0, 1.0
    else:
        exponent = bisect_exponent(sources, total, target)
        p = F.col("tokens") / F.lit(float(total))
        z, least = sources.where("tokens > 0").agg(F.sum(F.pow(p, F.lit(exponent))), F.min(F.pow(p, F.lit(exponent - 1)))).first()
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    if target.budget is None:
        epochs = F.pow(share, F.lit(exponent - 1)) / F.lit(least)
        wanted = F.greatest(F.floor(epochs * F.col("tokens") + 0.5), F.col("tokens"))
    else:
        wanted = F.floor(weight * F.lit(target.budget) + 0.5)
    some = F.col("tokens") > 0
    plan = sources.select(
        "source",
        "tokens",
        F.when(some, weight).otherwise(0.0).alias("weight"),
        F.when(some, wanted).otherwise(0).cast("long").alias("target_tokens"),
    )
    full = F.when(some, F.floor(F.col("target_tokens") / F.col("tokens"))).otherwise(1).cast("long")
    plan = plan.withColumn("full_epochs", full)
    return plan.withColumn("rest", F.col("target_tokens") - F.col("full_epochs") * F.col("tokens"))


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


def block_of(doc_id: Column, blocks: int) -> Column:
    return F.conv(F.substring(_key(doc_id), 1, 8), 16, 10).cast("long") % blocks


def block_table(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """How the last epoch takes each block of sums (source, block, n_tokens): whole, or up to so many tokens (room), or not at all."""
    blocks = sums.withColumnRenamed("n_tokens", "block_tokens").join(plan, "source")
    blocks = blocks.withColumn("place", F.struct(_key("full_epochs", "source", "block").alias("key"), "block"))
    order = Window.partitionBy("source").orderBy("place")
    upto = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("upto", upto).withColumn("block_rank", F.row_number().over(order).cast("long"))
    whole = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    room = F.greatest(F.col("rest") - F.col("upto") + F.col("block_tokens"), F.lit(0))
    return stored(blocks.select("source", "block", "place", "block_rank", "weight", "full_epochs", whole.alias("whole"), room.alias("room")))


def cut_table(blocks: DataFrame) -> DataFrame:
    """Of each source the place of its last whole block, the block that crosses the budget, and the room in it."""
    crosses = ~F.col("whole") & (F.col("room") > 0)
    return stored(
        blocks.groupBy("source").agg(
            F.max("weight").alias("weight"),
            F.max("full_epochs").alias("full_epochs"),
            F.max(F.when(F.col("whole"), F.col("place"))).alias("last"),
            F.max(F.when(crosses, F.struct("block", "room"))).alias("crossing"),
        )
    )


def _dealt(df: DataFrame, target: Target) -> tuple[DataFrame, DataFrame]:
    """The draws of df, and the table of blocks."""
    rows, row = wrapped(df), F.col("row")
    own = F.coalesce(row["doc_id"].cast("string"), F.lit(""))
    blocks = max(BLOCKS, -(-df.count() // BLOCK_ROWS))
    rows = rows.select(
        "row",
        F.coalesce(row["source"], F.lit("")).alias("source"),
        count_words(row["text"]).alias("n_tokens"),
        block_of(own, blocks).alias("block"),
    )
    sums = stored(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")))
    told = block_table(sums, plan_table(source_table(sums), target))
    joined = rows.join(cut_table(told), "source")
    crosses = F.coalesce(F.col("block") == F.col("crossing.block"), F.lit(False))
    place = F.struct(_key("full_epochs", "source", "block").alias("key"), "block")
    whole = F.coalesce(place <= F.col("last"), F.lit(False))
    shown = ("row", "source", "n_tokens", "block", "weight")
    plain = joined.where(~crosses).select(*shown, (F.col("full_epochs") + whole.cast("long")).alias("copies"))
    rest = [row[f.name] for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    order = Window.partitionBy("source").orderBy(_key("full_epochs", own), "n_tokens", F.xxhash64(row["text"]), F.xxhash64(*rest))
    upto = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = joined.where(crosses).withColumn("upto", upto)
    edge = edge.select(*shown, (F.col("full_epochs") + (F.col("upto") <= F.col("crossing.room")).cast("long")).alias("copies"))
    taken = plain.union(edge).where("copies > 0")
    return taken.select(*shown, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch")), told


def draws(df: DataFrame, target: Target = Target()) -> DataFrame:
    """Every row of df (doc_id, source, text and others) as often as the mix takes it.

    row (all columns of df), source, n_tokens, block, weight of the source, epoch.
    """
    return _dealt(df, target)[0]


def mix(df: DataFrame, target: Target = Target()) -> DataFrame:
    """The rows of df, each as often as the mix takes it."""
    return unwrapped(draws(df, target), df.columns)


def sampled(df: DataFrame, target: Target = Target()) -> DataFrame:
    """What mix() takes, without texts: doc_id, source, n_tokens, epoch, block, block_rank (in the last epoch) and weight of every draw."""
    found, blocks = _dealt(df.select("doc_id", "source", "text"), target)
    found = found.select("row.doc_id", "source", "n_tokens", "epoch", "block", F.round("weight", 9).alias("weight"))
    return found.join(blocks.select("source", "block", "block_rank"), ["source", "block"])
