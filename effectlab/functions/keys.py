"""Condition keys, labels, fingerprints and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.numeric import as_col

# The spacing between repeated unit cycles, and the zero-dose tolerance.
CYCLE_STEP = 10_000
ZERO_DOSE = 1e-12

#: Doses are told apart to twelve places, the tolerance of a zero dose.
DOSE_TYPE = "decimal(29,12)"


def dose_key(dose: Column | str) -> Column:
    """A decimal form of a dose, safe to join on; null beyond 10**17 or without a number."""
    return as_col(dose).try_cast(DOSE_TYPE)


def dose_slug(dose: Column | str) -> Column:
    """``0.75`` -> ``p0p750``, ``-0.75`` -> ``m0p750``."""
    value = as_col(dose).cast("double")
    sign = F.when(value >= 0, F.lit("p")).otherwise(F.lit("m"))
    return F.concat(sign, F.replace(F.format_string("%.3f", F.abs(value)), F.lit("."), F.lit("p")))


def condition_path(unit: Column | str, arm: Column | str, dose: Column | str) -> Column:
    """Where the object of one condition is kept below a run folder."""
    file_name = F.concat(F.lit("alpha_"), dose_slug(dose), F.lit(".png"))
    folder = F.concat(F.lit("seed_"), as_col(unit).cast("string"))
    return F.concat_ws("/", F.lit("images"), folder, as_col(arm), file_name)


def label_for(
    df: DataFrame,
    levels: DataFrame,
    *,
    base: str,
    template: str,
    target_arm: str,
    slot: str = "{level}",
    arm: str = "arm",
    dose: str = "dose",
) -> DataFrame:
    """Attach ``label``: the base text, or the template filled with the dose's level.

    ``levels(level_key, level)`` spells its keys as text; both sides join on the decimal
    value, so ``-2``, ``-2.0`` and ``-2.00`` name one dose. Of several spellings the one
    first in text order counts, and :func:`repeated_levels` lists them. A dose of the
    target arm that finds no level has ``label_missing`` set.
    """
    keyed = levels.groupBy(F.col("level_key").try_cast(DOSE_TYPE).alias("_level_key")).agg(
        F.min_by("level", F.struct("level_key", "level")).alias("_level")
    )
    needs = (F.col(arm) == F.lit(target_arm)) & (F.abs(F.col(dose)) >= F.lit(ZERO_DOSE))
    wanted = F.when(needs, dose_key(dose))
    joined = df.withColumn("_wanted", wanted).join(keyed, F.col("_wanted") == F.col("_level_key"), "left")
    filled = F.replace(F.lit(template), F.lit(slot), F.col("_level"))
    return (
        joined.withColumn("label", F.when(needs, filled).otherwise(F.lit(base)))
        .withColumn("label_missing", needs & F.col("_level").isNull())
        .drop("_wanted", "_level_key", "_level")
    )


def repeated_levels(levels: DataFrame) -> DataFrame:
    """Doses that ``levels`` spells more than once: ``dose, spellings, levels``."""
    named = levels.groupBy(F.col("level_key").try_cast(DOSE_TYPE).alias("dose")).agg(
        F.count(F.lit(1)).alias("spellings"), F.count_distinct("level").alias("levels")
    )
    return named.where((F.col("spellings") > 1) & F.col("dose").isNotNull())


def fingerprint(columns: Sequence[str], length: int = 12) -> Column:
    """A short SHA-256 over the compact JSON of the columns in name order."""
    ordered = F.struct(*[F.col(name) for name in sorted(columns)])
    payload = F.to_json(ordered, {"ignoreNullFields": "false"})
    return F.substring(F.sha2(payload, 256), 1, length)


def extend_units(position: Column | str, base: Sequence[int]) -> Column:
    """The unit at ``position`` of a finite list continued without repeats."""
    if not base:
        raise ValueError("the base unit list must not be empty")
    index = as_col(position)
    size = F.lit(len(base))
    listed = F.array(*[F.lit(int(value)).cast("bigint") for value in base])
    offset = F.element_at(listed, (F.pmod(index, size) + 1).cast("int"))
    return offset + F.floor(index / size).cast("bigint") * F.lit(CYCLE_STEP)


def content_sha256(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)


def normalize_ws(text: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(as_col(text), r"\s+", " "))


def direction_of(dose: Column | str) -> Column:
    return F.signum(as_col(dose).cast("double")).cast("int")


def with_direction(df: DataFrame, dose: str = "dose", response: str = "response") -> DataFrame:
    """Add the sign of the dose and the response aligned to it."""
    sign = direction_of(dose)
    return df.withColumn("direction", sign).withColumn(
        "aligned_change", sign * F.col(response).cast("double")
    )


def hashed(per_image: DataFrame) -> DataFrame:
    """A table of one row per image as the side of a join that is hashed in the tasks. The
    planner knows neither how many pixels an image has nor that boxes unpack to more than
    their file, and would send one of the sides through the driver."""
    return per_image.hint("shuffle_hash")
