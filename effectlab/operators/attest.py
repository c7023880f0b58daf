"""Attestations: the latest record per path, and its agreement with what is expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlab.functions.ordering import last_per_key


def latest_attestation(df: DataFrame, order: Sequence[Column | str], path: str = "path") -> DataFrame:
    """The last record of every path in ledger order."""
    return last_per_key(df, [path], order)


def attestation_check(
    items: DataFrame, latest: DataFrame, fields: Sequence[str], path: str = "path"
) -> DataFrame:
    """``valid`` per expected item: the latest record has every expected value."""
    record = latest.select(path, *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_recorded"))
    joined = items.join(record, path, "left")
    equal = F.coalesce(F.col("_recorded"), F.lit(False))
    for f in fields:
        equal = equal & F.col(f).eqNullSafe(F.col(f"_r_{f}"))
    return joined.select(path, *fields, equal.alias("valid"))


def campaign_complete(checked: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """Whether all items are attested and, given the number of pairs, none is absent."""
    facts = checked.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("valid").alias("n_valid")
    )
    whole = F.col("n_items") == F.col("n_valid")
    if n_pairs is not None:
        whole = whole & (F.col("n_items") == 2 * n_pairs)
    return facts.withColumn("campaign_complete", whole)
