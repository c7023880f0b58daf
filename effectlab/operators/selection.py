"""Selections: shards, previews, key sets, representative units, top-two gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.numeric import flag
from effectlab.functions.ordering import quantiles, row_positions
from effectlab.schema import Names
from effectlab.session import written


def shard(df: DataFrame, index: int, count: int, order: str) -> DataFrame:
    """Every ``count``-th row by ``order`` (distinct values), starting at ``index``."""
    if count < 1 or not 0 <= index < count:
        raise ValueError("a shard needs count >= 1 and 0 <= index < count")
    placed = row_positions(df.withColumn("_one", F.lit(1)), ["_one"], order, "_position")
    return placed.where(F.pmod(F.col("_position"), F.lit(count)) == index).drop("_one", "_position")


def split_eligible(df: DataFrame, names: Names = Names()) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and the rest; missing flags count as incomplete."""
    done = flag(names.generated) & flag(names.complete)
    return df.where(done), df.where(~done)


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` offenders in key order."""
    return df.orderBy(*order).limit(n)


def union_ledgers(*ledgers: DataFrame) -> DataFrame:
    """All rows of several ledgers; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)


def key_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def key_minus(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def top2_gap(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Best minus second-best score per group (0 with fewer than two scores).

    Two aggregates instead of a ranking: the largest value, how often it occurs, and the
    largest value below it. Both combine before the shuffle.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    pair = F.struct(F.col(score).alias("v"), F.col("_n").alias("n"))
    best = counts.groupBy(*by).agg(F.max(pair).alias("_best"), F.max_by(score, score).alias("_v"))
    # max(struct) carries the multiplicity of the best value; the next value needs a second look.
    if by:
        joined = counts.join(best.select(*by, F.col("_best.v").alias("_top"), F.col("_best.n").alias("_times")), list(by))
    else:
        joined = counts.withColumn("_b", best.select("_best").scalar()).select(
            "*", F.col("_b.v").alias("_top"), F.col("_b.n").alias("_times")
        )
    gaps = joined.groupBy(*by).agg(
        F.max("_top").alias("_top"),
        F.max("_times").alias("_times"),
        F.max(F.when(F.col(score) < F.col("_top"), F.col(score))).alias("_next"),
    )
    gap = F.when(F.col("_times") > 1, F.lit(0.0)).otherwise(F.coalesce(F.col("_top") - F.col("_next"), F.lit(0.0)))
    return gaps.select(*by, gap.alias("gap"))


def select_unit(
    matched: DataFrame, baseline: str | Column, names: Names = Names()
) -> DataFrame:
    """The representative unit of the smallest target, as one row.

    Units with the most complete rows are candidates; of these the one whose median
    baseline is closest to the median over candidates wins, then the lowest unit.
    """
    base = F.col(baseline) if isinstance(baseline, str) else baseline
    smallest = matched.agg(F.min("target_change").alias("t"))
    rows = matched.withColumn("_t", smallest.scalar()).where(F.abs(F.col("target_change") - F.col("_t")) <= 1e-8 + 1e-5 * F.abs(F.col("_t")))
    # Three narrow columns of one target, read by several branches: kept as a table.
    rows = written(rows.select(names.unit, flag("match_complete").alias("_done"), base.cast("double").alias("_base")), "units")
    per_unit = rows.groupBy(names.unit).agg(F.count_if("_done").alias("_n")).where("_n > 0")
    most = per_unit.agg(F.max("_n").alias("n"))
    candidates = per_unit.withColumn("_most", most.scalar()).where(F.col("_n") == F.col("_most"))
    medians = quantiles(rows.join(candidates, names.unit, "left_semi"), [names.unit], "_base", {"_b": 0.5})
    middle = quantiles(medians, [], "_b", {"_median": 0.5})
    judged = candidates.join(medians, names.unit, "left").withColumn("_median", middle.scalar())
    return judged.groupBy().agg(
        F.min_by(F.struct(names.unit, "_b"), F.struct(F.coalesce(F.abs(F.col("_b") - F.col("_median")), F.lit(float("inf"))), F.col(names.unit))).alias("_w"),
        F.max("_median").alias("median_baseline"),
        F.max("_n").alias("max_complete_rows"),
        F.count(F.lit(1)).alias("candidates"),
    ).select(
        F.col(f"_w.{names.unit}").alias("selected_unit"),
        F.col("_w._b").alias("unit_baseline"),
        "median_baseline", "max_complete_rows", "candidates",
    )
