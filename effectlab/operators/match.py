"""Matching conditions at an equal achieved effect, and the coverage of the match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.keys import with_direction
from effectlab.functions.numeric import finite, flag, ratio
from effectlab.functions.ordering import default_order, first_per_key, null_safe_join, quantiles
from effectlab.schema import Names


def nearest_to_target(
    df: DataFrame,
    targets: Sequence[float],
    names: Names = Names(),
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Per unit, arm, direction and target: the row whose aligned change is closest.

    Ties go to the row first in ``order`` (by default the lesser dose, then
    :func:`default_order`). The
    targets are a short list of parameters and are expanded inside each row, and the
    choice is an aggregate with a partial step, so no group is gathered.
    """
    if not targets or any(float(t) <= 0 for t in targets):
        raise ValueError("matched-change targets must be positive")
    usable = (
        df.withColumn(names.response, finite(names.response))
        .where(F.col(names.response).isNotNull() & (F.col(names.dose) != 0))
        .where(F.col(names.unit).isNotNull() & F.col(names.arm).isNotNull())
    )
    aligned = with_direction(usable, names.dose, names.response)
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_change")
    expanded = aligned.select("*", wanted).withColumn(
        "match_distance", F.abs(F.col("aligned_change") - F.col("target_change"))
    )
    keys = [names.unit, names.arm, "direction", "target_change"]
    return first_per_key(expanded, keys, ["match_distance", *(order or [names.dose, *default_order(expanded)])])


def match_at_target(
    df: DataFrame,
    targets: Sequence[float],
    tolerance: float,
    names: Names = Names(),
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Nearest rows with ``match_complete`` telling which are within the tolerance.

    Rows outside the tolerance stay: they count in coverage but not in contrasts.
    """
    nearest = nearest_to_target(df, targets, names, order)
    return nearest.withColumn("match_complete", F.col("match_distance") <= F.lit(float(tolerance)))


def coverage(matched: DataFrame, names: Names = Names(), extra: Sequence[str] = ()) -> DataFrame:
    """Matched and attempted units per stratum, with achieved change and distance over
    the complete rows."""
    by = [*extra, names.arm, "direction", "target_change"]
    done = flag("match_complete")
    table = matched.select(
        *by,
        names.unit,
        F.when(done, F.col(names.unit)).alias("_done_unit"),
        F.when(done, finite("aligned_change")).alias("_achieved"),
        F.when(done, finite("match_distance")).alias("_distance"),
    )
    summary = table.groupBy(*by).agg(
        F.count_distinct(names.unit).alias("attempted_units"),
        F.count_distinct("_done_unit").alias("complete_units"),
        F.avg("_achieved").alias("mean_achieved_change"),
        F.stddev_samp("_achieved").alias("std_achieved_change"),
        F.avg("_distance").alias("mean_match_distance"),
    )
    medians = quantiles(table, by, "_distance", {"median_match_distance": 0.5})
    joined = null_safe_join(summary, medians, by, "left")
    return joined.select(
        *by,
        "attempted_units",
        "complete_units",
        ratio(F.col("complete_units"), F.col("attempted_units")).alias("coverage_rate"),
        "mean_achieved_change",
        "std_achieved_change",
        "mean_match_distance",
        "median_match_distance",
    )


def coverage_expected(matched: DataFrame, expected: DataFrame, names: Names = Names()) -> DataFrame:
    """Coverage against a planned unit list (``expected`` has the unit column), with the
    distance taken over all rows, complete or not."""
    by = [names.arm, "direction", "target_change"]
    planned = expected.select(names.unit).distinct().withColumn("_planned", F.lit(True))
    size = planned.agg(F.count(F.lit(1)).alias("n"))
    tagged = matched.where(F.col(names.arm).isNotNull()).join(planned, names.unit, "left")
    table = tagged.withColumn("_distance", finite("match_distance"))
    summary = table.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("_planned"), F.col(names.unit))).alias("observed_units"),
        F.count_distinct(F.when(flag("match_complete"), F.col(names.unit))).alias("matched_units"),
        F.max("_distance").alias("max_match_distance"),
    )
    medians = quantiles(table, by, "_distance", {"median_match_distance": 0.5})
    joined = null_safe_join(summary, medians, by, "left").withColumn("expected_units", size.scalar())
    return joined.select(
        *by,
        "expected_units",
        "observed_units",
        "matched_units",
        ratio(F.col("matched_units"), F.col("expected_units")).alias("coverage_rate"),
        "median_match_distance",
        "max_match_distance",
    )


def full_coverage(covered: DataFrame, arms: DataFrame, names: Names = Names()) -> DataFrame:
    """Whether every arm of ``arms`` in both directions is present and fully matched,
    that is, matches as many units as were expected.

    One row: ``expected_strata, missing_strata, extra_strata, short_strata, full_coverage``.
    """
    planned = arms.select(names.arm).distinct().select(
        names.arm, F.explode(F.array(F.lit(-1), F.lit(1))).alias("direction"), F.lit(True).alias("_planned")
    )
    found = covered.groupBy(names.arm, "direction").agg(
        F.bool_or(F.col("matched_units") != F.col("expected_units")).alias("_short")
    )
    both = planned.join(found.withColumn("_found", F.lit(True)), [names.arm, "direction"], "full")
    counted = both.agg(
        F.count_if(F.col("_planned")).alias("expected_strata"),
        F.count_if(F.col("_planned") & F.col("_found").isNull()).alias("missing_strata"),
        F.count_if(F.col("_found") & F.col("_planned").isNull()).alias("extra_strata"),
        F.count_if(F.col("_found") & F.col("_short")).alias("short_strata"),
        F.count_if(F.col("_found")).alias("_observed"),
    )
    clean = (F.col("missing_strata") == 0) & (F.col("extra_strata") == 0) & (F.col("short_strata") == 0)
    return counted.withColumn("full_coverage", clean & (F.col("_observed") > 0)).drop("_observed")
