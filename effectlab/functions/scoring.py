"""Threshold gate and composite score over preservation metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.numeric import finite

CORE = ("face_similarity", "lpips", "background_ssim")

# Weights of the composite score, and the share of checks to pass.
WEIGHTS = {"face_similarity": 0.3, "landmark_rmse": 0.2, "lpips": 0.2, "background_ssim": 0.2, "total_pose_diff": 0.1}
PASS_SHARE = 0.8
SAME_ENTITY = 0.85


@dataclass(frozen=True)
class Thresholds:
    """Limits of the gate."""

    face_similarity: float = 0.85
    landmark_rmse: float = 5.0
    lpips: float = 0.3
    background_ssim: float = 0.75
    total_pose_diff: float = 5.0


HIGHER_IS_BETTER = {"face_similarity", "background_ssim"}


def _value(df: DataFrame, name: str) -> Column:
    return finite(name) if name in df.columns else F.lit(None).cast("double")


def gate(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add ``pass_count, total_count, missing_required_metrics, is_disentangled``.

    A row passes when all core metrics are present and at least 80 percent of the checks
    on present metrics hold.
    """
    checks = []
    for name in WEIGHTS:
        limit, value = F.lit(getattr(limits, name)), _value(df, name)
        checks.append(value >= limit if name in HIGHER_IS_BETTER else value <= limit)
    missing = F.array_compact(F.array(*[F.when(_value(df, n).isNull(), F.lit(n)) for n in CORE]))
    judged = df.withColumn("_checks", F.array_compact(F.array(*checks))).withColumn("missing_required_metrics", missing)
    judged = judged.withColumns(
        {"pass_count": F.size(F.filter("_checks", lambda c: c)), "total_count": F.size("_checks")}
    )
    enough = F.col("pass_count") >= F.lit(PASS_SHARE) * F.col("total_count") - 1e-12
    passed = (F.size("missing_required_metrics") == 0) & (F.col("total_count") > 0) & enough
    return judged.withColumn("is_disentangled", passed).drop("_checks")


def overall_score(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add the weighted mean of the scaled metrics that are present, 0 with none."""
    score, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        value = _value(df, name)
        part = value if name in HIGHER_IS_BETTER else F.greatest(F.lit(0.0), 1 - value / F.lit(getattr(limits, name)))
        part = F.when(value.isNotNull(), part)
        score = score + F.coalesce(part * w, F.lit(0.0))
        weight = weight + F.when(part.isNotNull(), w).otherwise(0.0)
    return df.withColumn("overall_score", F.coalesce(F.try_divide(score, weight), F.lit(0.0)))


def is_same(similarity: Column | str, threshold: float = SAME_ENTITY) -> Column:
    return (F.col(similarity) if isinstance(similarity, str) else similarity) >= threshold
