"""The registry behind ``__spark_entry__``: a Spark plan and, where SQL can state it,
the query a second engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    def register(build):
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = Plan(build, sql)
        return build

    return register


def r6(value: Column | str, name: str | None = None) -> Column:
    """Six decimals, the precision at which both engines are compared."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6).alias(name or value)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def q6(expression: str) -> str:
    """SQL text of the same rounding; adding zero turns -0.0 into 0.0."""
    return f"(round(({expression})::DOUBLE, 6) + 0.0)"
