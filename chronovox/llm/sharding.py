"""Sharding by a Feistel permutation with cycle walking over global row numbers.

The permuted row number alone gives the place: shard = p mod shards, slot = p div shards. So shards differ by one row
at most, slots have no gaps, and anyone can compute a row's place, or (with the inverse) the row at a place, without
moving data."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import in_order

ROUNDS = 6
_PRIME = (1 << 31) - 1


class Permutation:
    """A keyed bijection of range(n).

    The two halves of a number are its quotient and remainder by `right`, so that the domain left * right exceeds n by
    less than sqrt(n) + 1; numbers that fall outside walk their cycle until they are inside again."""

    def __init__(self, n: int, seed: int = 0):
        if not 0 <= n < 1 << 61:
            raise ValueError("n is out of range")
        self.n = n
        self.right = max(1, isqrt(max(0, n - 1)) + 1)
        self.left = max(1, -(-n // self.right))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.keys = rng.integers(1, _PRIME, size=(ROUNDS, 3), dtype=np.int64)

    def _mix(self, half: np.ndarray, k: int) -> np.ndarray:
        a, b, c = self.keys[k]
        x = (half % _PRIME * a + b) % _PRIME
        x ^= x >> 15
        x = x * c % _PRIME
        x ^= x >> 13
        return x * a % _PRIME

    def _forward(self, x: np.ndarray) -> np.ndarray:
        high, low = x // self.right, x % self.right
        for k in range(ROUNDS):
            if k % 2:
                low = (low + self._mix(high, k)) % self.right
            else:
                high = (high + self._mix(low, k)) % self.left
        return high * self.right + low

    def _backward(self, x: np.ndarray) -> np.ndarray:
        high, low = x // self.right, x % self.right
        for k in reversed(range(ROUNDS)):
            if k % 2:
                low = (low - self._mix(high, k)) % self.right
            else:
                high = (high - self._mix(low, k)) % self.left
        return high * self.right + low

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, dtype=np.int64))
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = step(x[out])
        return x

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self._forward)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self._backward)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with global row numbers from 0 in the given order, and the number of rows.

    Rows are dealt into ranges of the order, numbered inside each, and shifted by the rows of the ranges before; no task
    sees more than its range, and the driver sees one number. Rows equal in all of `order` are dealt by their place in
    the input, so that any number of them spreads over ranges; they may swap numbers."""
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    total = df.count()
    return in_order(placed, [*map(F.col, order), F.col("__place")], {name: F.lit(1)}, {}).drop("__place").withColumn(name, F.col(name).cast("long")), total


def shuffled_shards(df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """df with columns row_number, place, shard and slot.

    `order` must tell rows apart for the result to be reproducible; rows equal in all of it are interchangeable. Nulls
    come first in the order. An empty table gives an empty one. One key with a third of all rows does no harm: places
    depend on row numbers only, and rows are dealt by the order and, where that is equal, by their place."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows, total = numbered(df, order)
    permutation = Permutation(total, seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(row.to_numpy(copy=True)))

    return (
        rows.withColumn("place", place("row_number"))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {int(shards)}"))
    )
