"""Holm step-down adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlab.functions.numeric import finite
from effectlab.functions.ordering import null_safe_join, positions, running_max, value_counts


def holm(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Add Holm-adjusted p-values, per family; rows without a finite p keep a null.

    Tied p-values share the adjustment of the first of them, so it is enough to adjust
    the distinct values of a family; that takes a rank and a running maximum, both in
    two levels, and so a family may be of any size.
    """
    by = list(family) or ["_family"]
    base = df if family else df.withColumn("_family", F.lit(1))
    values = base.select(*by, finite(p).alias("_p"))
    ranked = positions(value_counts(values, by, "_p"), by, "_p")
    step = ranked.withColumn("_step", F.least(F.lit(1.0), (F.col("total") - F.col("before")) * F.col("_p")))
    adjusted = running_max(step, by, "_p", "_step", name).select(*by, "_p", name)
    keyed = base.withColumn("_p", finite(p))
    return null_safe_join(keyed, adjusted, [*by, "_p"], "left").drop("_p", "_family")
