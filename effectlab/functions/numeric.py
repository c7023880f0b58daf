"""Numeric coercion, finiteness, and JSON-safe values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """The value as a double, or null when it is not a finite number."""
    number = as_col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(INFINITY)), number)


def is_finite(value: Column | str) -> Column:
    return finite(value).isNotNull()


def flag(value: Column | str) -> Column:
    """A completion flag with missing counted as false."""
    return F.coalesce(as_col(value), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _safe(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < F.lit(INFINITY)), value).cast(kind)
    if isinstance(kind, T.ArrayType) and _has_floats(kind.elementType):
        return F.transform(value, lambda item: _safe(item, kind.elementType))
    if isinstance(kind, T.MapType) and _has_floats(kind.valueType):
        return F.transform_values(value, lambda _, item: _safe(item, kind.valueType))
    if isinstance(kind, T.StructType) and _has_floats(kind):
        inner = [_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    return value


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_floats(field.dataType) for field in kind.fields)
    return False


def json_safe(df: DataFrame) -> DataFrame:
    """Replace every NaN and infinity, however nested, by null."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# Fixed value: the protocol's name for the pose metric and its ledger column.
METRIC_ALIASES = {"pose_difference": "total_pose_diff"}


def missing_metrics(
    required: Sequence[str],
    columns: Sequence[str],
    aliases: Mapping[str, str] = METRIC_ALIASES,
) -> Column:
    """Names of the required metrics without a finite value, in the order given."""
    entries = []
    for name in required:
        column = aliases.get(name, name)
        if column in columns:
            entries.append(F.when(~is_finite(column), F.lit(name)))
        else:
            entries.append(F.lit(name))
    return F.array_compact(F.array(*entries))


def missing_required(
    df: DataFrame,
    required: Sequence[str],
    aliases: Mapping[str, str] = METRIC_ALIASES,
) -> DataFrame:
    """Add ``missing_required_metrics`` and the completeness flag it implies."""
    missing = missing_metrics(required, df.columns, aliases)
    return df.withColumn("missing_required_metrics", missing).withColumn(
        "evaluation_complete", F.size("missing_required_metrics") == 0
    )
