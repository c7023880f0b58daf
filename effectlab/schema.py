"""Column vocabulary and fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Names:
    """Column names of a trial table; the defaults are the generic vocabulary."""

    unit: str = "unit"
    arm: str = "arm"
    dose: str = "dose"
    response: str = "response"
    generated: str = "generated"
    complete: str = "complete"

    @property
    def key(self) -> list[str]:
        return [self.unit, self.arm, self.dose]

    @staticmethod
    def ledger() -> "Names":
        """The names used by result ledgers on disk."""
        return Names(
            unit="seed",
            arm="method",
            dose="alpha",
            response="skin_tone_change",
            generated="generation_complete",
            complete="evaluation_complete",
        )


@dataclass(frozen=True)
class Outcome:
    """An outcome column and its orientation (+1 higher is better, -1 lower)."""

    name: str
    orientation: float


# Preservation outcomes of a ledger and their orientation.
LEDGER_OUTCOMES = (
    Outcome("face_similarity", 1.0),
    Outcome("lpips", -1.0),
    Outcome("background_ssim", 1.0),
    Outcome("total_pose_diff", -1.0),
)

# Metrics described by default, in report order.
LEDGER_METRICS = (
    "skin_tone_change",
    "lightness_change",
    "face_similarity",
    "landmark_rmse",
    "lpips",
    "background_ssim",
    "overall_ssim",
    "total_pose_diff",
)

# Columns that must agree before repeated conditions collapse.
RESULT_COLUMNS = (
    "generation_complete",
    "evaluation_complete",
    "skin_tone_change",
    "lightness_change",
    "face_similarity",
    "landmark_rmse",
    "lpips",
    "background_ssim",
    "overall_ssim",
    "total_pose_diff",
)

# Metrics summarised per run.
RUN_METRICS = (
    "face_similarity",
    "landmark_rmse",
    "lpips",
    "background_ssim",
    "overall_ssim",
    "total_pose_diff",
    "overall_score",
)


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


LEDGER_SCHEMA = T.StructType(
    _fields(T.StringType(), "schema_version study_id config_fingerprint")
    + [T.StructField("seed", T.LongType()), T.StructField("method", T.StringType())]
    + [T.StructField("alpha", T.DoubleType())]
    + _fields(T.BooleanType(), "generation_complete evaluation_complete")
    + _fields(T.StringType(), "image_path")
    + _fields(
        T.DoubleType(),
        "face_similarity landmark_rmse lpips background_ssim overall_ssim"
        " yaw_diff pitch_diff roll_diff total_pose_diff overall_score",
    )
    + _fields(T.BooleanType(), "is_disentangled")
    + _fields(T.IntegerType(), "pass_count total_count")
    + [T.StructField("missing_required_metrics", T.ArrayType(T.StringType()))]
    + _fields(T.StringType(), "skin_tone_metric skin_tone_failure")
    + _fields(T.BooleanType(), "skin_tone_complete")
    + _fields(T.DoubleType(), "original_ita edited_ita skin_tone_change lightness_change")
    + _fields(T.IntegerType(), "original_skin_pixels edited_skin_pixels")
    + _fields(T.BooleanType(), "original_white_normalized edited_white_normalized")
    + _fields(T.StringType(), "error_type error_message traceback")
)

_IMAGE_REF = T.StructType(_fields(T.StringType(), "descriptor path sha256"))

PAIR_MANIFEST_SCHEMA = T.StructType(
    _fields(T.StringType(), "schema_version status study_config_fingerprint model_id model_revision")
    + _fields(T.IntegerType(), "inference_steps height width n_pairs")
    + _fields(T.DoubleType(), "guidance_scale")
    + _fields(T.BooleanType(), "generation_observed_in_this_run generation_observed_in_campaign")
    + _fields(T.StringType(), "generation_signature generation_ledger generation_ledger_sha256")
    + [
        T.StructField(
            "pairs",
            T.ArrayType(
                T.StructType(
                    _fields(T.StringType(), "pair_id")
                    + _fields(T.LongType(), "seed")
                    + [T.StructField("light", _IMAGE_REF), T.StructField("dark", _IMAGE_REF)]
                )
            ),
        )
    ]
)

RUN_MANIFEST_SCHEMA = T.StructType(
    _fields(T.StringType(), "schema_version study_id config_fingerprint study_status execution_mode")
    + _fields(T.LongType(), "condition_count")
    + [T.StructField("execution_seeds", T.ArrayType(T.LongType()))]
    + _fields(T.StringType(), "started_at_utc")
)

ATTESTATION_SCHEMA = T.StructType(
    _fields(T.StringType(), "schema_version group")
    + _fields(T.LongType(), "index")
    + _fields(T.StringType(), "path descriptor")
    + _fields(T.LongType(), "seed")
    + _fields(T.StringType(), "generation_signature sha256 generated_at_utc")
)

RUN_METADATA_SCHEMA = T.StructType(
    _fields(T.LongType(), "seed")
    + _fields(T.StringType(), "method")
    + [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    _fields(T.StringType(), "method")
                    + _fields(T.DoubleType(), "alpha")
                    + _fields(T.BooleanType(), "evaluation_complete")
                    + _fields(T.DoubleType(), " ".join(RUN_METRICS))
                )
            ),
        )
    ]
)

CONTRAST_SCHEMA = T.StructType(
    _fields(T.StringType(), "reference_method comparator")
    + _fields(T.IntegerType(), "direction")
    + _fields(T.DoubleType(), "target_change")
    + _fields(T.StringType(), "outcome")
    + _fields(T.LongType(), "n_pairs")
    + _fields(
        T.DoubleType(),
        "mean_reference_advantage median_reference_advantage ci_low ci_high p_value p_holm",
    )
)
