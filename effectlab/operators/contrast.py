"""Within-unit contrasts of arms, tolerance sweeps, and locked replication families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlab.functions.numeric import finite, flag
from effectlab.functions.ordering import null_safe_join, quantiles
from effectlab.operators.match import coverage, nearest_to_target
from effectlab.operators.multiplicity import holm
from effectlab.operators.resample import Resampling, bootstrap_ci, sign_flip_p
from effectlab.schema import LEDGER_OUTCOMES, Names, Outcome
from effectlab.session import written

STRATUM = ["comparator", "direction", "target_change", "outcome"]


def pair_arms(
    matched: DataFrame,
    reference_arm: str,
    outcomes: Sequence[Outcome] = LEDGER_OUTCOMES,
    names: Names = Names(),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Oriented advantage of the reference arm over each comparator, within units.

    One join of the complete rows on unit, direction and target serves all comparators
    and outcomes; the outcomes are unpivoted after it, so the join moves wide rows once.
    """
    present = [o for o in outcomes if o.name in matched.columns]
    usable = matched.where(flag("match_complete"))
    keys = [*extra, names.unit, "direction", "target_change"]
    values = [finite(o.name).alias(f"_v{i}") for i, o in enumerate(present)]
    reference = usable.where(F.col(names.arm) == reference_arm).select(
        *keys, *[v.alias(f"_r{i}") for i, v in enumerate(values)]
    )
    others = usable.where(F.col(names.arm) != reference_arm).select(
        *keys, F.col(names.arm).alias("comparator"), *values
    )
    cells = [
        F.struct(
            F.lit(o.name).alias("outcome"),
            (F.lit(o.orientation) * (F.col(f"_r{i}") - F.col(f"_v{i}"))).alias("advantage"),
        )
        for i, o in enumerate(present)
    ]
    joined = others.join(reference, keys)
    return joined.select(*keys, "comparator", F.inline(F.array(*cells)))


def _strata(
    matched: DataFrame, reference_arm: str, outcomes: Sequence[Outcome], names: Names, extra: Sequence[str]
) -> DataFrame:
    """Every comparator x direction x target x outcome, also those without a pair.

    The levels are the distinct values among complete rows, a handful per design; they
    are collected as sets and expanded, so nothing is joined.
    """
    usable = matched.where(flag("match_complete"))
    others = F.when(F.col(names.arm) != reference_arm, F.col(names.arm))
    levels = usable.groupBy(*extra).agg(
        F.collect_set(others).alias("_arms"), F.collect_set("direction").alias("_directions"), F.collect_set("target_change").alias("_targets")
    )
    listed = F.array(*[F.lit(o.name) for o in outcomes if o.name in matched.columns])
    by_arm = levels.select(*extra, "_directions", "_targets", F.explode("_arms").alias("comparator"))
    by_direction = by_arm.select(*extra, "comparator", "_targets", F.explode("_directions").alias("direction"))
    by_target = by_direction.select(*extra, "comparator", "direction", F.explode("_targets").alias("target_change"))
    return by_target.select("*", F.explode(listed).alias("outcome"))


def paired_contrasts(
    matched: DataFrame,
    reference_arm: str,
    outcomes: Sequence[Outcome] = LEDGER_OUTCOMES,
    names: Names = Names(),
    bootstrap: Resampling | None = Resampling(),
    flips: Resampling | None = Resampling(resamples=100_000),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Reference-arm advantage per comparator, direction, target and outcome.

    Holm runs across the whole result, or within each value of ``extra`` where the
    table holds several analyses side by side.
    """
    by = [*extra, *STRATUM]
    columns = [*extra, names.unit, names.arm, "direction", "target_change", "match_complete"]
    kept = [*columns, *[o.name for o in outcomes if o.name in matched.columns]]
    # Read by several branches below, so both are computed once and kept as tables.
    matched = written(matched.where(flag("match_complete")).select(*kept), "matched")
    pairs = written(
        pair_arms(matched, reference_arm, outcomes, names, extra).where(F.col("advantage").isNotNull()), "pairs"
    )
    summary = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("advantage").alias("mean_reference_advantage")
    )
    medians = quantiles(pairs, by, "advantage", {"median_reference_advantage": 0.5})
    table = _strata(matched, reference_arm, outcomes, names, extra)
    for part in (summary, medians):
        table = null_safe_join(table, part, by, "left")
    if bootstrap is not None:
        ends = bootstrap_ci(pairs, by, names.unit, "advantage", bootstrap)
        table = null_safe_join(table, ends.drop("n"), by, "left")
    if flips is not None:
        p = sign_flip_p(pairs, by, names.unit, "advantage", flips)
        table = written(null_safe_join(table, p.drop("n"), by, "left"), "contrasts")
        table = holm(table, "p_value", extra)
    return table.withColumn("reference_arm", F.lit(reference_arm)).withColumn(
        "n_pairs", F.coalesce("n_pairs", F.lit(0).cast("bigint"))
    )


def at_tolerances(nearest: DataFrame, tolerances: Sequence[float]) -> DataFrame:
    """Judge one set of nearest rows under several tolerances: the distance does not
    depend on the tolerance, so the match itself is made once."""
    if not tolerances or any(float(t) <= 0 for t in tolerances):
        raise ValueError("every tolerance must be positive")
    listed = F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(tolerances))])).alias("tolerance")
    return nearest.select("*", listed).withColumn("match_complete", F.col("match_distance") <= F.col("tolerance"))


def tolerance_sweep(
    df: DataFrame,
    targets: Sequence[float],
    tolerances: Sequence[float],
    reference_arm: str,
    outcomes: Sequence[Outcome] = LEDGER_OUTCOMES,
    names: Names = Names(),
    bootstrap: Resampling | None = Resampling(),
    flips: Resampling | None = Resampling(resamples=100_000),
) -> tuple[DataFrame, DataFrame]:
    """Coverage and contrasts for every tolerance, Holm within each of them."""
    judged = at_tolerances(nearest_to_target(df, targets, names), tolerances)
    return (
        coverage(judged, names, ["tolerance"]),
        paired_contrasts(judged, reference_arm, outcomes, names, bootstrap, flips, ["tolerance"]),
    )


def pair_count_ranges(contrasts: DataFrame, by: Sequence[str] = ("tolerance",)) -> DataFrame:
    """Smallest and largest number of pairs behind the contrasts of each tolerance."""
    return contrasts.groupBy(*by).agg(F.min("n_pairs").alias("min_pairs"), F.max("n_pairs").alias("max_pairs"))


# How the two directions are named in reports.
DIRECTION_LABELS = {-1: "lighter", 1: "darker"}


def replication_family(
    contrasts: DataFrame,
    comparator: str,
    outcome: str,
    target: float,
    labels: dict[int, str] = DIRECTION_LABELS,
    reference_arm: str | None = None,
) -> DataFrame:
    """The locked rows of a replication, with a Holm correction of their own.

    One row per labelled direction is expected. ``family_valid`` is false on every row
    when a direction is absent or doubled, or a p-value is missing.
    """
    chosen = contrasts.where(
        (F.col("comparator") == comparator)
        & (F.col("outcome") == outcome)
        & (F.col("target_change") == float(target))
        & F.col("direction").isin(*labels)
    )
    if reference_arm is not None:
        chosen = chosen.where(F.col("reference_arm") == reference_arm)
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    chosen = chosen.withColumn("direction_label", F.try_element_at(named, F.col("direction")))
    counts = chosen.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("direction").alias("dirs"), F.count("p_value").alias("ps")
    )
    size = len(labels)
    valid = counts.select((F.col("rows") == size) & (F.col("dirs") == size) & (F.col("ps") == size))
    return holm(chosen, "p_value", name="p_holm_family").withColumn("family_valid", valid.scalar())


def decide(
    family: DataFrame, minimum_pairs: int = 12, level: float = 0.05, by: Sequence[str] = (), size: int = 2
) -> DataFrame:
    """The ordered decision rule over a family: validity, coverage, sign, then strictness.

    A family that hasn't ``size`` rows, is marked as not valid, or lacks a p-value though
    it has enough pairs gets no verdict but ``invalid_family``.
    """
    c = F.col
    marked = c("family_valid") if "family_valid" in family.columns else F.lit(True)
    valid = marked & (c("p_holm_family").isNotNull() | (c("n_pairs") < minimum_pairs))
    facts = family.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(F.coalesce(valid, F.lit(False))).alias("_valid"),
        F.bool_or(c("n_pairs") < minimum_pairs).alias("_short"),
        F.bool_or(c("mean_reference_advantage") <= 0).alias("_adverse"),
        F.bool_and(F.coalesce(c("ci_low") > 0, F.lit(False))).alias("_above"),
        F.bool_and(F.coalesce(c("p_holm_family") < level, F.lit(False))).alias("_significant"),
    )
    verdict = (
        F.when((c("n_rows") != size) | ~F.coalesce(c("_valid"), F.lit(False)), F.lit("invalid_family"))
        .when(c("_short"), F.lit("inconclusive_coverage"))
        .when(c("_adverse"), F.lit("failure_to_replicate"))
        .when(c("_above") & c("_significant"), F.lit("strict_replication"))
        .otherwise(F.lit("directional_replication"))
    )
    return facts.select(*by, "n_rows", verdict.alias("decision"))


def compare_families(
    replication: DataFrame, parent: DataFrame, keys: Sequence[str] = ("direction",)
) -> DataFrame:
    """Replication rows beside their parent rows, one to one on ``keys``.

    ``one_to_one`` is false where either side repeats the key.
    """
    columns = ["n_pairs", "mean_reference_advantage", "ci_low", "ci_high"]
    keys = list(keys)
    before = parent.select(*keys, *[F.col(c).alias(f"parent_{c}") for c in columns])
    repeats = (
        replication.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionAll(parent.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(*keys)
        .agg(((F.sum("a") <= 1) & (F.sum("b") <= 1)).alias("one_to_one"))
    )
    same = F.col("mean_reference_advantage") * F.col("parent_mean_reference_advantage") > 0
    return replication.join(before, keys).join(repeats, keys).withColumn("same_sign_as_parent", same)
