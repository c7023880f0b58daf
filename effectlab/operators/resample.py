"""Bootstrap intervals and sign-flip p-values per stratum.

A stratum is its values in order; rows of one value are counted before anything is moved,
so a frequent value is one row however often it occurs. Positions in that order are cut
into shards of about ``shard_rows``, and replicates into blocks. A task turns one shard and
block into a vector of partial sums, one number a replicate; the vectors of a stratum are
added up in two levels and read once at the end. Draws come from a counter (see
``functions.rng``) or, in a bootstrap of several shards, from a generator keyed by shard and
block, so a replicate is the same however the rows are partitioned or a task retried, and no
stratum is gathered.

* *Bootstrap.* The n draws of a replicate fall on n positions. A stratum has 2**d shards of
  equal width n / 2**d; where a shard's edge cuts a position, both sides hold their part of
  it. The n draws are dealt down the binary tree over the shards, each node passing a
  Binomial(draws, 1/2) to its left: these are keyed by (seed, node, block), so all shards
  below a node work out the same number. A shard deals its draws on to pieces of 256
  positions, and inside a piece a draw is uniform. A stratum of one shard deals nothing. The
  law is that of n uniform draws with replacement at any size.
* *Sign flips.* Each position has one random sign per replicate; partial sums add up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effectlab.functions.numeric import finite
from effectlab.functions.ordering import null_safe_join, positions, value_counts
from effectlab.functions.rng import SIGN_BITS, draws, uniform_below

_CELLS = 1 << 16  # replicate x row cells a kernel holds at a time
_PIECE = 1 << 8  # positions of which two are told by 16 bits
_PAIRS = 1 << 16  # pairs a kernel draws at a time


@dataclass(frozen=True)
class Resampling:
    """Resampling parameters. ``block`` is a number of replicates, a multiple of SIGN_BITS."""

    resamples: int = 10_000
    confidence: float = 0.95
    seed: int = 2026
    shard_rows: int = 32_768
    block: int = 2_048


def _strata(df: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Runs of equal values (by..., _x, n, before, total), one row per stratum, and what a
    stratum is told by: a constant if by nothing."""
    whole = [] if by else [F.lit(1).alias("_all")]
    rows = df.select(*by, *whole, finite(value).alias("_x")).where(F.col("_x").isNotNull())
    by = list(by) or ["_all"]
    counts = value_counts(rows, by, "_x")
    # Whole multiples of a value, added in the order of values, are the same in any plan.
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("_x") * F.col("n")).alias("_sum"))
    return positions(counts, by, "_x").where("total >= 2"), sizes, by


def depth(n: int | Column, shard_rows: int) -> int | Column:
    """Levels of the tree over the shards of a stratum of n rows."""
    if isinstance(n, Column):
        return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(shard_rows))))).cast("int")
    return max(0, int(np.ceil(np.log2(n / shard_rows))))


def _keys(table: pa.Table, by: Sequence[str]) -> list[pa.Array]:
    """The stratum of a group, from its first row."""
    return [table.column(c).slice(0, 1).combine_chunks() for c in by]


def _fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def _vectors(runs: DataFrame, by: Sequence[str], config: Resampling, kernel: Callable) -> DataFrame:
    """(by..., _block, sums, total): the replicate sums of each stratum and block, packed.

    ``runs`` has a row for each run and shard that it reaches into, and ``_shards``.
    """
    replicates, block = config.resamples, config.block
    blocks = -(-replicates // block)
    names = [*by, "_block", "_part", "total", "sums"]
    own = [T.StructField("_block", T.IntegerType()), T.StructField("_part", T.LongType()), T.StructField("total", T.LongType()), T.StructField("sums", T.BinaryType())]
    schema = T.StructType([*_fields(runs, by), *own])
    told = [T.StructField(c, T.LongType()) for c in ("_shard", "_shards", "total", "_first")]
    shards = T.StructType([*_fields(runs, by), *told, T.StructField("_values", T.BinaryType()), T.StructField("_counts", T.BinaryType())])

    def gathered(table: pa.Table) -> pa.Table:
        """A shard as one row: its first position, values and how often each stands there."""
        table = table.sort_by("before")
        n, x = (table.column(c).to_numpy() for c in ("n", "_x"))
        made = [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("_shard", "_shards", "total", "before")]
        packs = [pa.array([x.astype(np.float64).tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes() if (n != 1).any() else b""], pa.binary())]
        return pa.Table.from_arrays([*_keys(table, by), *made, *packs], shards.names)

    def packed(table: pa.Table, number: int, part: int, total: int, sums: np.ndarray) -> pa.Table:
        made = [pa.array([number], pa.int32()), pa.array([part], pa.int64()), pa.array([total], pa.int64()), pa.array([sums.tobytes()], pa.binary())]
        return pa.Table.from_arrays([*_keys(table, by), *made], names)

    def one(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("_block", "_shard", "_shards", "total", "_first")}
        reps = np.arange(first["_block"] * block, min(replicates, (first["_block"] + 1) * block))
        x, n = np.frombuffer(table.column("_values")[0].as_buffer()), np.frombuffer(table.column("_counts")[0].as_buffer(), np.int64)
        n = n if len(n) else np.ones(len(x), np.int64)
        before = first["_first"] + np.cumsum(n) - n
        sums = kernel(before, n, x, first["total"], first["_shard"], first["_shards"], first["_block"], reps)
        # About the square root of the shards meet in each of as many first sums.
        return packed(table, first["_block"], first["_shard"] // max(1, int(np.sqrt(first["_shards"]))), first["total"], sums)

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("_part").to_pylist(), (v.as_buffer() for chunk in table.column("sums").chunks for v in chunk)), key=lambda p: (p[0], bytes(p[1])))
        sums = np.zeros(len(parts[0][1]) // 8)
        for _, part in parts:
            sums += np.frombuffer(part)
        return packed(table, table.column("_block")[0].as_py(), 0, table.column("total")[0].as_py(), sums)

    # Runs are moved once, whatever the number of blocks; a block gets its shards packed. Few
    # bytes are much work here, so tasks aren't made fewer by size.
    spark = runs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    whole = runs.groupBy(*by, "_shard").applyInArrow(gathered, shards)
    dealt = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).repartition(tasks, *by, "_shard", "_block")
    partial = dealt.groupBy(*by, "_shard", "_block").applyInArrow(one, schema)
    first = partial.groupBy(*by, "_block", "_part").applyInArrow(add, schema)
    return first.groupBy(*by, "_block").applyInArrow(add, schema)


def _deal(seed: int, levels: int, shard: int, block: int, total: int, count: int) -> np.ndarray:
    """The draws that each of ``count`` replicates of a block has for a shard."""
    dealt = np.full(count, total, np.int64)
    for level in range(levels):
        node = (1 << level) + (shard >> (levels - level))
        left = np.random.Generator(np.random.Philox(key=[seed, (block << 40) + node])).binomial(dealt, 0.5)
        dealt = left if (shard >> (levels - level - 1)) & 1 == 0 else dealt - left
    return dealt


def _bootstrap_kernel(seed: int) -> Callable:
    def kernel(before, n, x, total, shard, shards, block, reps):
        levels = shards.bit_length() - 1
        # The shard covers [shard * total, (shard + 1) * total) in units of 1 / shards of a row.
        low, values = int(before[0]), np.repeat(x, n)
        sums = np.empty(len(reps))
        if levels == 0:
            step = max(1, _CELLS // total)
            item = np.arange(total)[None, :]
            for at in range(0, len(reps), step):
                drawn = draws(seed, reps[at : at + step, None], item)
                sums[at : at + step] = values[uniform_below(drawn, total)].sum(axis=1)
            return sums
        # Draws of a shard come from one generator, keyed by (seed, block, leaf of the tree).
        dealt = _deal(seed, levels, shard, block, total, len(reps))
        bits = np.random.SFC64([seed, block, shards + shard])
        width, begin = total / shards, (shard * total - (low << levels)) / shards
        return _drawn(bits, values, begin, begin + width, dealt)

    return kernel


def _drawn(bits: np.random.BitGenerator, values: np.ndarray, begin: float, end: float, dealt: np.ndarray) -> np.ndarray:
    """Sums of ``dealt`` draws from the positions that [begin, end) covers, an outer one by the
    part of it that is covered. The draws of each replicate are dealt to pieces of ``_PIECE`` positions;
    there two draws are the 16 bits that tell a pair of values, whose sum is looked up."""
    generator = np.random.Generator(bits)
    edges = np.unique(np.concatenate([[0], np.arange(1, len(values), _PIECE), [max(1, len(values) - 1), len(values)]]))
    sizes = np.maximum(np.minimum(edges[1:], end) - np.maximum(edges[:-1], begin), 0.0)
    counts = generator.multinomial(dealt, sizes / sizes.sum())
    sums = np.zeros(len(dealt))
    # All chunks fill the same arrays.
    most = int(counts.max(initial=0))
    room = max(most // 2, _PAIRS) + 1
    items, drawn, pairs = np.empty(room, np.intp), np.empty(room), np.empty((_PIECE, _PIECE))
    for piece, (first, last) in enumerate(zip(edges[:-1], edges[1:])):
        own, of = values[first:last], counts[:, piece]
        if last - first == 1:
            sums += own[0] * of
        elif last - first < _PIECE:
            sums += _added(np.append(own.take(generator.integers(0, last - first, of.sum())), 0.0), of)
        else:
            np.add(own[:, None], own[None, :], out=pairs)
            sums += np.where(of % 2 == 1, own.take(_words(bits, len(of)) & (_PIECE - 1)), 0.0)
            halves = of // 2
            step = max(1, 2 * _PAIRS // max(1, most))
            for at in range(0, len(of), step):
                half = halves[at : at + step]
                count = int(half.sum())
                np.copyto(items[:count], _words(bits, count))
                pairs.ravel().take(items[:count], out=drawn[:count], mode="wrap")
                drawn[count] = 0.0
                sums[at : at + step] += _added(drawn[: count + 1], half)
    return sums


def _words(bits: np.random.BitGenerator, count: int) -> np.ndarray:
    """``count`` numbers of 16 random bits."""
    return bits.random_raw(-(-count // 4)).view(np.uint16)[:count]


def _added(drawn: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of ``of`` draws each, one replicate's after the other's; a zero is their end."""
    return np.where(of > 0, np.add.reduceat(drawn, np.cumsum(of) - of), 0.0)


def _sign_kernel(seed: int) -> Callable:
    def kernel(before, n, x, total, shard, shards, block, reps):
        values = np.repeat(x, n)
        words = np.unique(reps // SIGN_BITS)
        sums = np.empty(len(words) * SIGN_BITS)
        step = max(1, _CELLS // len(values))
        item = np.arange(len(values))[None, :]
        whole = values.sum()
        for at in range(0, len(words), step):
            word = draws(seed, words[at : at + step, None], item, shard)
            for i in range(len(word)):
                bits = np.unpackbits(word[i].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                place = (at + i) * SIGN_BITS
                # The bits are the rows with a minus.
                sums[place : place + SIGN_BITS] = whole - 2.0 * (values @ bits.astype(float))
        return sums[reps - words[0] * SIGN_BITS]

    return kernel


def _exploded(runs: DataFrame, first: Column, last: Column, shards: Column) -> DataFrame:
    return runs.select("*", shards.alias("_shards"), F.explode(F.sequence(first, last)).alias("_shard"))


def _clipped(runs: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs cut to the positions [low, high] that their shard reaches."""
    begin, end = F.greatest(F.col("before"), low), F.least(F.col("before") + F.col("n") - 1, high)
    return runs.withColumns({"before": begin, "n": end - begin + 1})


def bootstrap_ci(
    df: DataFrame, by: Sequence[str], unit: str, value: str, config: Resampling = Resampling()
) -> DataFrame:
    """Percentile interval of the mean per stratum: ``by..., n, ci_low, ci_high``.

    Non-finite values are dropped; fewer than two values give a null interval. ``unit``
    names the rows for readers; the draws need positions only.
    """
    wanted = list(by)
    runs, sizes, by = _strata(df, by, value)
    levels = depth(F.col("total"), config.shard_rows)
    wide = runs.withColumn("_d", levels).withColumn("_w", F.expr("shiftleft(1L, _d)"))
    # Products of a position and 2**d stay below 2**63 for strata up to 2**39 rows.
    first = F.expr("(before * _w) div total")
    last = F.expr("((before + n) * _w - 1) div total")
    dealt = _exploded(wide, first, last, F.col("_w"))
    dealt = _clipped(dealt, F.expr("(_shard * total) div _w"), F.expr("((_shard + 1) * total - 1) div _w")).drop("_d", "_w")
    vectors = _vectors(dealt, by, config, _bootstrap_kernel(config.seed))
    tail = (1.0 - config.confidence) / 2.0

    def ends(table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        order = np.argsort(table.column("_block").to_numpy())
        sums = table.column("sums").to_pylist()
        means = np.concatenate([np.frombuffer(sums[i]) for i in order]) / total
        low, high = np.quantile(means, [tail, 1.0 - tail])
        return pa.Table.from_arrays([*_keys(table, by), pa.array([low]), pa.array([high])], [*by, "ci_low", "ci_high"])

    schema = T.StructType([*_fields(vectors, by), T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())])
    found = vectors.groupBy(*by).applyInArrow(ends, schema)
    return null_safe_join(sizes, found, by, "left").select(*wanted, "n", "ci_low", "ci_high")


def sign_flip_p(
    df: DataFrame, by: Sequence[str], unit: str, value: str, config: Resampling = Resampling(resamples=100_000, shard_rows=4_096, block=16_384)
) -> DataFrame:
    """Two-sided paired sign-flip p-value per stratum: ``by..., n, p_value``.

    ``(extreme + 1) / (resamples + 1)``; a flip equal to the observed mean is extreme.
    """
    if config.block % SIGN_BITS:
        raise ValueError(f"a block of flips is a multiple of {SIGN_BITS}")
    wanted = list(by)
    runs, sizes, by = _strata(df, by, value)
    rows = config.shard_rows
    dealt = _exploded(runs, F.expr(f"before div {rows}"), F.expr(f"(before + n - 1) div {rows}"), F.expr(f"(total + {rows - 1}) div {rows}"))
    dealt = _clipped(dealt, F.col("_shard") * rows, (F.col("_shard") + 1) * rows - 1)
    vectors = _vectors(dealt, by, config, _sign_kernel(config.seed))
    # Each block meets the observed sum by itself, and only its count goes on.
    observed = null_safe_join(vectors, sizes.select(*by, "_sum"), by)

    def extreme(batches):
        for batch in batches:
            sums, seen = batch.column("sums"), batch.column("_sum").to_numpy()
            # The observed sum is added up in the same order as the flips only up to rounding.
            counts = [int(np.count_nonzero(np.abs(np.frombuffer(s.as_buffer())) >= abs(o) * (1.0 - 1e-12))) for s, o in zip(sums, seen)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in by), pa.array(counts, pa.int64())], [*by, "extreme"])

    schema = T.StructType([*_fields(vectors, by), T.StructField("extreme", T.LongType())])
    counted = observed.mapInArrow(extreme, schema).groupBy(*by).agg(F.sum("extreme").alias("extreme"))
    p = (F.col("extreme") + F.lit(1.0)) / F.lit(config.resamples + 1.0)
    return null_safe_join(sizes, counted, by, "left").select(*wanted, "n", p.alias("p_value"))
