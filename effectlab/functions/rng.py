"""Counter-based draws: the 64 bits of a draw depend on (seed, stream, replicate, item)
only, so a replicate does not change with the partitioning of the data or the retry of a
task. The generator is Philox 2x32 with seven rounds: products of 32-bit words, which
NumPy and plain SQL work out alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier and the key step of the generator, and its rounds.
MULTIPLIER, KEY_STEP, ROUNDS = 0xD256D193, 0x9E3779B9, 7
# How seed and stream are spread over a key.
SEED_STEP, STREAM_STEP = 40692, 0x85EBCA6B
WORD = 1 << 32
SIGN_BITS = 64


def draws(seed: int, replicate: np.ndarray, item: np.ndarray, stream: np.ndarray | int = 0) -> np.ndarray:
    """64-bit draws of ``item`` (below 2**32) in each ``replicate`` (below 2**32) and
    ``stream`` (below 2**31), broadcast against each other."""
    mask, half = np.uint64(WORD - 1), np.uint64(32)
    shape = np.broadcast_shapes(np.shape(replicate), np.shape(item), np.shape(stream))
    left = np.broadcast_to(np.asarray(item).astype(np.uint64), shape).copy()
    right = np.broadcast_to(np.asarray(replicate).astype(np.uint64), shape).copy()
    key = (np.uint64(seed * SEED_STEP % WORD) + np.asarray(stream).astype(np.uint64) * np.uint64(STREAM_STEP)) & mask
    product = np.empty(shape, np.uint64)
    for _ in range(ROUNDS):
        np.multiply(left, np.uint64(MULTIPLIER), out=product)
        np.right_shift(product, half, out=left)
        left ^= right
        left ^= key
        np.bitwise_and(product, mask, out=right)
        key = (key + np.uint64(KEY_STEP)) & mask
    left <<= half
    left |= right
    return left


def uniform_below(draw: np.ndarray, n: int) -> np.ndarray:
    """Integers below ``n`` (at most 2**53) from 64-bit draws."""
    return ((draw >> np.uint64(11)) * (n / 9007199254740992.0)).astype(np.int64)


def draw_column(seed: int, replicate: Column, item: Column, stream: Column | None = None) -> Column:
    """The upper 62 bits of the same draws, as a Spark column of non-negative integers."""

    @F.pandas_udf("bigint")
    def drawn(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for replicates, items, streams in parts:
            made = draws(seed, replicates.to_numpy(), items.to_numpy(), streams.to_numpy())
            yield pd.Series((made >> np.uint64(2)).astype(np.int64))

    given = (replicate, item, F.lit(0) if stream is None else stream)
    return drawn(*[c.cast("bigint") for c in given])


def draw_sql(source: str, seed: int, replicate: str, item: str, stream: str = "0") -> str:
    """A select over ``source`` with the words of the draw added as ``hi`` and ``lo`` (UBIGINT)."""
    out = f"select *, ({item})::UBIGINT hi, ({replicate})::UBIGINT lo, (({seed}::BIGINT * {SEED_STEP} + ({stream})::BIGINT * {STREAM_STEP}) % {WORD})::UBIGINT dk from {source}"
    for _ in range(ROUNDS):
        out = (
            f"select * replace (xor(xor((hi * {MULTIPLIER}::UBIGINT) >> 32, lo), dk) as hi, (hi * {MULTIPLIER}::UBIGINT) & {WORD - 1}::UBIGINT as lo,"
            f" (dk + {KEY_STEP}::UBIGINT) & {WORD - 1}::UBIGINT as dk) from ({out})"
        )
    return f"select * exclude (dk) from ({out})"


def below_sql(n: str) -> str:
    """:func:`uniform_below` of columns ``hi`` and ``lo``."""
    return f"floor((hi * 2097152::UBIGINT + (lo >> 11))::DOUBLE * (({n})::DOUBLE / 9007199254740992.0))::BIGINT"
