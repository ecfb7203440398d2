"""Shapes of Bloom filters: m bits, k hash functions, and what follows from them by arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    m: int
    k: int

    def __post_init__(self):
        if self.m <= 0 or self.k <= 0:
            raise ValueError("a shape needs bits and hash functions")

    @classmethod
    def from_np(cls, n: int, p: float) -> Shape:
        """The shape that holds ``n`` items at a false positive rate of ``p``."""
        if n <= 0 or not 0 < p < 1:
            raise ValueError("n must be positive and p between 0 and 1")
        m = math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2)))
        return cls(m, max(1, math.floor(math.log(2) * m / n + 0.5)))

    @property
    def words(self) -> int:
        return -(-self.m // 64)

    @property
    def positions(self) -> int:
        return self.words * 8

    def fpp(self, n: int) -> float:
        return (1 - (1 - 1 / self.m) ** (self.k * n)) ** self.k

    def expected_bits(self, n: int) -> float:
        kn = self.k * n
        collisions = kn - self.m + self.m * ((self.m - 1) / self.m) ** kn
        return kn - collisions

    def entries_per_row(self, n: int) -> float:
        """Rows that one filter of ``n`` items adds to the chunk index: one per bit, at most one per byte."""
        return min(self.expected_bits(n), self.m / 8)


def from_np(n: Column, p: Column) -> tuple[Column, Column]:
    """m and k as columns."""
    m = F.ceil(n * F.ln(p) / F.ln(F.lit(1.0) / F.pow(F.lit(2.0), F.ln(F.lit(2.0)))))
    return m.cast("long"), F.floor(F.ln(F.lit(2.0)) * m / n + 0.5).cast("long")


def entries_per_row(m: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """Expected bits and index entries of a row as columns."""
    kn = k * n
    bits = m - m * F.pow((m - 1) / m, kn)
    return bits, F.least(bits, m / 8)


def estimate_rows(entries: Column, ratio: float, base: Column) -> Column:
    """Rows behind so many index entries: 0 of an empty index; the base table's own estimate without a ratio."""
    if ratio <= 0:
        return F.when(entries == 0, F.lit(0).cast("long")).otherwise(base.cast("long"))
    return F.when(entries == 0, F.lit(0).cast("long")).otherwise(F.floor(entries / F.lit(float(ratio)) + 0.5).cast("long"))
