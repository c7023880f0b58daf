"""Order statistics that never bring a whole group into one task.

A group may hold a third of all rows, so ranks, quantiles and running maxima are taken in
two levels. Equal values are first counted together (partial counts before the shuffle),
so a frequent value is one row. A quantile sketch of each group, merged from those of the
tasks, gives edges that cut its distinct values into about ``EDGES`` even buckets wherever
they lie. One window runs over the buckets of a group (a bounded number) and another inside
each bucket, and their sum is the exact position of the value in the group: the sketch
decides only how the work is dealt.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from effectlab.functions.numeric import as_col
from effectlab.sources.ledger import LEDGER_ORDER

# Edges between the buckets of a group, and the sketch's accuracy (rank error 1 / ACCURACY).
EDGES = 1023
ACCURACY = 10_000


def order_bucket(value: Column, edges: Column) -> Column:
    """How many of the ascending ``edges`` a value reaches, by bisection: never falls as the
    value rises. NaN, which Spark sorts last, reaches all."""
    steps = F.array(*[F.lit((EDGES + 1) >> i) for i in range(EDGES.bit_length() + 1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= value, at + step).otherwise(at))


def bucketed(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``_bucket``, monotone in ``value`` inside each group of ``by`` and even over
    the rows of ``df``."""
    number = F.col(value).cast("double")
    levels = F.array(*[F.lit(i / (EDGES + 1)) for i in range(1, EDGES + 1)])
    # A group has one edge for each of its values at most.
    edges = F.array_distinct(F.percentile_approx(number, levels, ACCURACY)).alias("_edges")
    if by:
        joined = null_safe_join(df, df.groupBy(*by).agg(edges), by, "left")
    else:
        joined = df.withColumn("_edges", df.agg(edges).scalar())
    return joined.withColumn("_bucket", order_bucket(number, F.col("_edges"))).drop("_edges")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping the left side's key columns."""
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *others)
    condition = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_r_{k}")), keys, F.lit(True))
    return left.join(renamed, condition, how).select(*left.columns, *others)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-null value of each group, with its multiplicity ``n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def positions(counts: DataFrame, by: Sequence[str], value: str, keep: Column | None = None) -> DataFrame:
    """Add ``before`` (rows of the group with a smaller value) and ``total``.

    ``counts`` holds one row per group and value with multiplicity ``n``. ``keep`` may
    name the buckets worth ranking, in terms of ``bucket_before``, ``bucket_n`` and
    ``total``; rows of other buckets are left out before they are sorted.
    """
    by = list(by)
    tagged = bucketed(counts, by, value)
    # The offsets come from the same counts, so the exchange behind them is reused.
    running = W.Window.partitionBy(*by).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy(*by)
    offsets = (
        tagged.groupBy(*by, "_bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .select(
            *by, "_bucket", "bucket_n",
            F.coalesce(F.sum("bucket_n").over(running), F.lit(0)).alias("bucket_before"),
            F.sum("bucket_n").over(whole).alias("total"),
        )
    )
    if keep is not None:
        offsets = offsets.where(keep)
    inside = W.Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.Window.unboundedPreceding, -1)
    joined = null_safe_join(tagged, offsets, [*by, "_bucket"])
    before = F.col("bucket_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return joined.select(*counts.columns, "total", before.alias("before"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group; ``probs`` maps names to levels."""
    by = list(by)
    single = not by
    if single:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    counts = value_counts(df.select(*by, F.col(value).cast("double").alias(value)), by, value)
    # Rank p*(total-1) lies between two neighbouring rows, low and low + 1.
    lows = {name: F.floor(F.lit(p) * (F.col("total") - 1)).cast("bigint") for name, p in probs.items()}

    def covers(before: Column, n: Column, rank: Column) -> Column:
        return (before <= rank) & (rank < before + n)

    def any_of(before: Column, n: Column) -> Column:
        hit = F.lit(False)
        for low in lows.values():
            hit = hit | covers(before, n, low) | covers(before, n, low + 1)
        return hit

    ranked = positions(counts, by, value, keep=any_of(F.col("bucket_before"), F.col("bucket_n")))
    aggregates = [F.max("total").alias("_total")]
    for name, low in lows.items():
        aggregates.append(F.max(F.when(covers(F.col("before"), F.col("n"), low), F.col(value))).alias(f"_lo_{name}"))
        aggregates.append(F.max(F.when(covers(F.col("before"), F.col("n"), low + 1), F.col(value))).alias(f"_hi_{name}"))
    picked = ranked.groupBy(*by).agg(*aggregates)
    columns = []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        share = rank - F.floor(rank)
        low, high = F.col(f"_lo_{name}"), F.coalesce(F.col(f"_hi_{name}"), F.col(f"_lo_{name}"))
        columns.append((low + (high - low) * share).alias(name))
    return picked.select(*([] if single else by), *columns)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged, for every row with a value, in groups of any size. NaN has
    no rank, like null; infinities are the least and the greatest values."""
    by = list(by)
    df = df.where(~F.isnan(F.col(value).cast("double")))
    ranked = positions(value_counts(df, by, value), by, value)
    rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    return null_safe_join(df.where(F.col(value).isNotNull()), ranked.select(*by, value, rank.alias(name)), [*by, value])


def row_positions(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """0-based position of each row by ``value``, which is distinct within its group."""
    by = list(by)
    ranked = positions(value_counts(df, by, value), by, value)
    return null_safe_join(df, ranked.select(*by, value, F.col("before").alias(name)), [*by, value])


def running_max(df: DataFrame, by: Sequence[str], value: str, peak: str, name: str) -> DataFrame:
    """Largest ``peak`` among the group's rows up to and including this ``value``."""
    by = list(by)
    tagged = bucketed(df, by, value)
    earlier = W.Window.partitionBy(*by).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*by, "_bucket")
        .agg(F.max(peak).alias("_peak"))
        .withColumn("_earlier", F.max("_peak").over(earlier))
        .drop("_peak")
    )
    inside = W.Window.partitionBy(*by, "_bucket").orderBy(value).rangeBetween(W.Window.unboundedPreceding, 0)
    joined = null_safe_join(tagged, offsets, [*by, "_bucket"])
    return joined.withColumn(
        name, F.greatest(F.max(peak).over(inside), F.col("_earlier"))
    ).drop("_bucket", "_earlier")


def default_order(df: DataFrame) -> list[str]:
    """The ledger order where a table has it, then all columns that can be sorted, by name:
    an order of rows that doesn't depend on how the table is stored."""
    ledger = [c for c in LEDGER_ORDER if c in df.columns]
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [*ledger, *sorted(c for c in plain if c not in ledger)]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key that comes first in ``order``.

    An aggregate rather than a window: every task keeps one row per key before the
    shuffle, so a hot key costs no more than any other.
    """
    return _one_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    return _one_per_key(df, keys, order, F.max_by)


def _one_per_key(df, keys, order, pick):
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.select(*keys).distinct()
    rank = F.struct(*[as_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
