"""Descriptive tables: dose-response summaries, missingness, monotonicity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from effectlab.functions.numeric import finite, flag, ratio
from effectlab.functions.ordering import default_order, first_per_key, null_safe_join, quantiles
from effectlab.operators.resample import Resampling, bootstrap_ci
from effectlab.schema import LEDGER_METRICS, RUN_METRICS, Names
from effectlab.session import written


def _metric(df: DataFrame, name: str) -> Column:
    return finite(name) if name in df.columns else F.lit(None).cast("double")


def long_metrics(df: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per input row and metric: ``metric``, ``value`` (null when not finite)."""
    pairs = [F.struct(F.lit(m).alias("metric"), _metric(df, m).alias("value")) for m in metrics]
    return df.select(*keep, F.inline(F.array(*pairs)))


def _moments(df: DataFrame, by: Sequence[str], metrics: Sequence[str], totals: list[Column]) -> DataFrame:
    """Count, mean and deviation of every metric in one pass over wide rows."""
    aggregates = list(totals)
    for i, m in enumerate(metrics):
        value = _metric(df, m)
        aggregates += [
            F.count(value).alias(f"_n{i}"),
            F.avg(value).alias(f"_m{i}"),
            F.stddev_samp(value).alias(f"_s{i}"),
        ]
    wide = df.groupBy(*by).agg(*aggregates)
    kept = [c for c in wide.columns if not c.startswith("_")]
    cells = [
        F.struct(
            F.lit(m).alias("metric"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std")
        )
        for i, m in enumerate(metrics)
    ]
    return wide.select(*kept, F.inline(F.array(*cells)))


def describe(
    df: DataFrame,
    metrics: Sequence[str] = LEDGER_METRICS,
    names: Names = Names(),
    resampling: Resampling | None = Resampling(),
) -> DataFrame:
    """Summary per arm, dose and metric. ``resampling=None`` leaves the interval out.

    A metric the table does not have still gives its all-missing rows.
    """
    by = [names.arm, names.dose]
    units = F.count_distinct(names.unit).alias("total_units")
    moments = _moments(df, by, metrics, [units])
    long = long_metrics(df, [*by, names.unit], metrics).where(F.col("value").isNotNull())
    keys = [*by, "metric"]
    joined = null_safe_join(moments, quantiles(long, keys, "value", {"median": 0.5}), keys, "left")
    columns = [*keys, F.col("n").alias("n_units"), (F.col("total_units") - F.col("n")).alias("n_missing"), "mean", "std", "median"]
    if resampling is None:
        return joined.select(*columns)
    intervals = bootstrap_ci(long, keys, names.unit, "value", resampling)
    joined = null_safe_join(joined, intervals.select(*keys, "ci_low", "ci_high"), keys, "left")
    return joined.select(*columns, "ci_low", "ci_high")


def summarize_runs(
    df: DataFrame,
    metrics: Sequence[str] = RUN_METRICS,
    names: Names = Names(),
    resampling: Resampling | None = Resampling(),
) -> DataFrame:
    """Run-level summary: count, mean, deviation and interval per arm, dose and metric."""
    by = [names.arm, names.dose]
    keys = [*by, "metric"]
    moments = _moments(df, by, metrics, [])
    if resampling is None:
        return moments.select(*keys, "n", "mean", "std")
    long = long_metrics(df, [*by, names.unit], metrics).where(F.col("value").isNotNull())
    intervals = bootstrap_ci(long, keys, names.unit, "value", resampling)
    joined = null_safe_join(moments, intervals.select(*keys, "ci_low", "ci_high"), keys, "left")
    return joined.select(
        *keys, "n", "mean", "std", F.col("ci_low").alias("ci95_low"), F.col("ci_high").alias("ci95_high")
    )


def summarize_batch(df: DataFrame, metrics: Sequence[str], gate: str = "is_disentangled") -> DataFrame:
    """Share of rows that pass the gate, and mean, deviation and median per metric."""
    passed = F.avg(F.when(F.col(gate), 100.0).otherwise(F.when(F.col(gate).isNotNull(), 0.0))).alias("pct_passed")
    present = [m for m in metrics if m in df.columns]
    moments = _moments(df, [], present, [passed])
    long = long_metrics(df, [], present)
    medians = quantiles(long, ["metric"], "value", {"median": 0.5})
    return moments.join(medians, "metric", "left").select("metric", "pct_passed", "n", "mean", "std", "median")


def group_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per group; flags count as 0 and 1."""
    return df.groupBy(*by).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])


def missingness(df: DataFrame, names: Names = Names()) -> DataFrame:
    """Attempted, generated and complete conditions per arm and dose, failures kept."""
    generated = flag(names.generated) if names.generated in df.columns else F.lit(False)
    complete = flag(names.complete) if names.complete in df.columns else F.lit(False)
    counted = df.groupBy(names.arm, names.dose).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(generated).alias("generated"),
        F.count_if(complete).alias("evaluation_complete"),
    )
    return counted.withColumn(
        "generation_failure_rate", ratio(F.col("attempted") - F.col("generated"), F.col("attempted"))
    ).withColumn(
        "metric_failure_rate", ratio(F.col("attempted") - F.col("evaluation_complete"), F.col("attempted"))
    )


def completion(table: DataFrame, names: Names = Names()) -> DataFrame:
    """Roll missingness up to arms, with the rates computed anew from the sums."""
    sums = table.groupBy(names.arm).agg(
        *[F.sum(c).alias(c) for c in ("attempted", "generated", "evaluation_complete")]
    )
    return sums.withColumn("generation_rate", ratio(F.col("generated"), F.col("attempted"))).withColumn(
        "evaluation_rate", ratio(F.col("evaluation_complete"), F.col("attempted"))
    )


def spearman_by_unit(
    df: DataFrame, names: Names = Names(), order: Sequence[Column | str] | None = None, least: int = 3
) -> DataFrame:
    """Rank correlation of dose and response per unit and arm.

    The first row of each dose in ``order`` counts (by default :func:`default_order`). What is left of a unit and arm is one row per
    distinct dose of the design, so the windows below hold a short list however many
    rows the unit had. A constant series has a null correlation and is still listed.
    """
    usable = df.select(
        names.unit, names.arm, names.dose, finite(names.response).alias("_y"),
        F.struct(*[F.col(o) if isinstance(o, str) else o for o in (order or default_order(df))]).alias("_order"),
    ).where("_y is not null").dropna(subset=[names.unit, names.arm, names.dose])
    once = first_per_key(usable, names.key, ["_order"])
    pair = [names.unit, names.arm]

    # Doses are distinct by now; responses may tie, and tied rows share their mean rank.
    by_dose = W.Window.partitionBy(*pair).orderBy(names.dose)
    by_response = W.Window.partitionBy(*pair).orderBy("_y")
    ties = F.count(F.lit(1)).over(by_response.rangeBetween(W.Window.currentRow, W.Window.currentRow))
    ranked = once.select(
        *pair,
        F.row_number().over(by_dose).cast("double").alias("x"),
        (F.rank().over(by_response) + (ties - 1) / F.lit(2.0)).alias("y"),
    )
    sums = ranked.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
    ).where(F.col("n") >= least)
    c = F.col
    spread = F.sqrt((c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy")))
    rho = F.try_divide(c("n") * c("sxy") - c("sx") * c("sy"), spread)
    return sums.select(*pair, rho.alias("spearman"))


def monotonicity(
    df: DataFrame,
    names: Names = Names(),
    order: Sequence[Column | str] | None = None,
    resampling: Resampling | None = Resampling(),
) -> DataFrame:
    """Per arm: units with a rank correlation, its mean, median and interval."""
    # One row per unit and arm, read by three branches: computed once and kept.
    per_unit = written(spearman_by_unit(df, names, order), "spearman")
    summary = per_unit.groupBy(names.arm).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("spearman").alias("mean_spearman")
    )
    medians = quantiles(per_unit, [names.arm], "spearman", {"median_spearman": 0.5})
    joined = summary.join(medians, names.arm, "left")
    columns = [names.arm, "n_units", "mean_spearman", "median_spearman"]
    if resampling is None:
        return joined.select(*columns)
    intervals = bootstrap_ci(per_unit, [names.arm], names.unit, "spearman", resampling)
    joined = joined.join(intervals.select(names.arm, "ci_low", "ci_high"), names.arm, "left")
    return joined.select(*columns, "ci_low", "ci_high")


def quantile_summary(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Count, mean, median and the 2.5 and 97.5 percent points per key and metric."""
    long = long_metrics(df, [key], metrics)
    summary = long.groupBy(key, "metric").agg(F.count("value").alias("n_resamples"), F.avg("value").alias("mean"))
    points = quantiles(long, [key, "metric"], "value", {"median": 0.5, "q025": 0.025, "q975": 0.975})
    return null_safe_join(summary, points, [key, "metric"], "left")


def dose_response_table(described: DataFrame, metric: str, names: Names = Names()) -> DataFrame:
    """Rows of one metric with the widths of its interval, for a dose-response curve."""
    return described.where(F.col("metric") == metric).select(
        names.arm, names.dose, "mean",
        (F.col("mean") - F.col("ci_low")).alias("err_low"),
        (F.col("ci_high") - F.col("mean")).alias("err_high"),
    )


def contrast_table(
    contrasts: DataFrame, outcomes: Sequence[str], comparators: Sequence[str], directions: Sequence[int] = (-1, 1)
) -> DataFrame:
    """Contrast rows of the listed outcomes, comparators and directions with widths."""
    chosen = contrasts.where(
        F.col("outcome").isin(*outcomes) & F.col("comparator").isin(*comparators) & F.col("direction").isin(*directions)
    )
    return chosen.select(
        "outcome", "comparator", "direction", F.col("mean_reference_advantage").alias("mean"),
        (F.col("mean_reference_advantage") - F.col("ci_low")).alias("err_low"),
        (F.col("ci_high") - F.col("mean_reference_advantage")).alias("err_high"),
    )


def coverage_selection(
    covered: DataFrame, target: float, arms: Sequence[str], directions: Sequence[int] = (-1, 1), names: Names = Names()
) -> tuple[DataFrame, DataFrame]:
    """The coverage rows of one target, and a one-row check that none is missing: there
    must be one per listed arm and direction (six for three arms)."""
    chosen = covered.where(
        (F.col("target_change") == float(target))
        & F.col(names.arm).isin(*arms)
        & F.col("direction").isin(*directions)
    )
    expected = len(arms) * len(directions)
    check = chosen.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("complete", F.col("n_rows") == expected)
    return chosen, check
