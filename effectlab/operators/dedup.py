"""Verified de-duplication of repeated conditions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.contracts import require_empty
from effectlab.schema import RESULT_COLUMNS, Names


@dataclass(frozen=True)
class Dedup:
    """Collapsed rows, the keys that were repeated, and the keys that disagree."""

    rows: DataFrame
    repeats: DataFrame
    conflicts: DataFrame

    def require_agreement(self) -> "Dedup":
        require_empty(self.conflicts, "repeated conditions disagree")
        return self


def dedup_verified(
    df: DataFrame,
    order: Sequence[Column | str],
    columns: Sequence[str] = RESULT_COLUMNS,
    atol: float = 1e-8,
    names: Names = Names(),
) -> Dedup:
    """Keep the first row of each condition if every repeat agrees with it.

    Agreement with the first row is decided by aggregates (extremes and counts per key),
    which combine before the shuffle; no repeat is compared pairwise or gathered.
    """
    keys = names.key
    common = [c for c in columns if c in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c for c in common if isinstance(types[c], T.NumericType)}

    def clean(c: str) -> Column:
        value = F.col(c)
        return F.nanvl(value.cast("double"), F.lit(None)) if c in numeric else value

    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    aggregates = [F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_first"), F.count(F.lit(1)).alias("n_repeats")]
    for i, c in enumerate(common):
        aggregates += [F.min(clean(c)).alias(f"_lo{i}"), F.max(clean(c)).alias(f"_hi{i}"), F.count(clean(c)).alias(f"_n{i}")]
    grouped = df.groupBy(*keys).agg(*aggregates)

    problems = []
    for i, c in enumerate(common):
        low, high, first = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_first.{c}")
        mixed = (F.col(f"_n{i}") != 0) & (F.col(f"_n{i}") != F.col("n_repeats"))
        if c in numeric:
            value = first.cast("double")
            apart = (low != high) & ((high - value > atol) | (value - low > atol))
        else:
            apart = low != high
        problems.append(F.when(mixed | F.coalesce(apart, F.lit(False)), F.lit(c)))
    judged = grouped.withColumn("conflicting", F.array_compact(F.array(*problems)) if problems else F.array())
    rows = judged.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
    repeats = judged.where("n_repeats > 1").select(*keys, "n_repeats")
    conflicts = judged.where(F.size("conflicting") > 0).select(*keys, F.array_join("conflicting", ",").alias("columns"))
    return Dedup(rows, repeats, conflicts)
