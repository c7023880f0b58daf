"""Contracts: tables that must be empty, and lookups that must find one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """A design or data contract does not hold."""


def require_empty(df: DataFrame, message: str, preview: int = 5) -> None:
    """Raise when ``df`` (a table of offenders) has any row, naming a few of them."""
    rows = df.limit(preview).collect()
    if rows:
        shown = "; ".join(str(row.asDict(recursive=True)) for row in rows)
        raise ContractViolation(f"{message}: {shown}")


def matching_rows(df: DataFrame, filters: dict) -> DataFrame:
    """The count of rows equal to every filter, and whether it is exactly one."""
    condition = F.lit(True)
    for name, value in filters.items():
        condition = condition & F.col(name).eqNullSafe(F.lit(value))
    return df.where(condition).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "exactly_one", F.col("n_rows") == 1
    )


def one_row(df: DataFrame, **filters) -> Row:
    """The only row equal to every filter; none or several break the contract."""
    condition = F.lit(True)
    for name, value in filters.items():
        condition = condition & (F.col(name) == F.lit(value))
    found = df.where(condition).limit(2).collect()
    if len(found) != 1:
        count = "no row" if not found else "several rows"
        raise ContractViolation(f"expected one row for {filters}, found {count}")
    return found[0]
