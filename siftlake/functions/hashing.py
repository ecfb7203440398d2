"""From items to bits: a hash of built-in functions, and Murmur3 128 where filters must equal foreign ones."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.shape import Shape

#: Fixed values of Murmur3 x64 128, and the seed that published filters were made with.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
N1, N2 = 0x52DCE729, 0x38495AB5
F1, F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SEED = 104729


def java_trim(text: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.btrim(text, F.lit("".join(map(chr, range(0x21)))))


def md5_bits(items: Column, shape: Shape) -> Column:
    """The distinct bits of an array of items, by double hashing of two 60-bit halves of MD5; empty items have none.

    Everything stays in the row and in built-in functions: no explode, no shuffle, no Python.
    """
    digests = F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), lambda x: F.md5(x.cast("binary")))
    # of a number modulo a power of two, the last digits tell
    digits = 15 if shape.m & (shape.m - 1) else max(1, min(15, -(-(shape.m.bit_length() - 1) // 4)))
    half = lambda d, a: F.conv(F.substring(d, a + 15 - digits, digits), 16, 10).cast("long") % shape.m
    pairs = F.transform(digests, lambda d: F.struct(half(d, 1).alias("a"), half(d, 16).alias("b")))
    each = F.transform(pairs, lambda s: F.array(*[(s["a"] + i * s["b"]) % shape.m for i in range(shape.k)]))
    return F.sort_array(F.array_distinct(F.flatten(each)))


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _finished(x: np.ndarray) -> np.ndarray:
    for factor in (F1, F2):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def murmur128(values: Sequence[bytes], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of Murmur3 x64 128 of all values at once."""
    size = np.array([len(v) for v in values], np.int64)
    blocks = int(size.max(initial=0)) // 16 + 1
    data = np.frombuffer(b"".join(v.ljust(blocks * 16, b"\0") for v in values), "<u8").reshape(len(values), blocks, 2)
    h1 = np.full(len(values), seed, np.uint64)
    h2 = h1.copy()
    c1, c2 = np.uint64(C1), np.uint64(C2)
    for b in range(blocks):
        k1 = _rotated(data[:, b, 0] * c1, 31) * c2
        k2 = _rotated(data[:, b, 1] * c2, 33) * c1
        full, tail = size >= (b + 1) * 16, size // 16 == b
        m1 = (_rotated(h1 ^ k1, 27) + h2) * np.uint64(5) + np.uint64(N1)
        m2 = (_rotated(h2 ^ k2, 31) + m1) * np.uint64(5) + np.uint64(N2)
        h1 = np.where(full, m1, np.where(tail, h1 ^ k1, h1))
        h2 = np.where(full, m2, np.where(tail, h2 ^ k2, h2))
    h1, h2 = h1 ^ size.astype(np.uint64), h2 ^ size.astype(np.uint64)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _finished(h1), _finished(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def trimmed(item: str | None) -> str:
    return (item or "").strip("".join(map(chr, range(0x21))))


def item_bits(items: Sequence[str | None], shape: Shape) -> list[list[int]]:
    """Sorted distinct bits of each item; an item that is empty once trimmed has none."""
    kept = [trimmed(x) for x in items]
    if not kept:
        return []
    h1, h2 = murmur128([x.encode() for x in kept])
    with np.errstate(over="ignore"):
        bits = (h1[:, None] + np.arange(shape.k, dtype=np.uint64) * h2[:, None]) % np.uint64(shape.m)
    return [sorted(set(row)) if item else [] for item, row in zip(kept, bits.tolist(), strict=True)]


def murmur_bits(items: Column, shape: Shape) -> Column:
    """The distinct bits of an array of items by Murmur3 128; Arrow batches, all items of a batch hashed at once."""

    @F.pandas_udf("array<long>")
    def bits(column: pd.Series) -> pd.Series:
        rows = [list(r) if r is not None else [] for r in column]
        flat = item_bits([x for r in rows for x in r], shape)
        out, at = [], 0
        for r in rows:
            out.append(sorted({b for x in flat[at : at + len(r)] for b in x}))
            at += len(r)
        return pd.Series(out)

    return bits(items)


def md5_item_bits(items: Sequence[str], shape: Shape) -> list[int]:
    """The bits of :func:`md5_bits` for a few items, on the driver."""
    out = set()
    for digest in (hashlib.md5(x.encode()).hexdigest() for x in items if x):
        a, b = int(digest[:15], 16) % shape.m, int(digest[15:30], 16) % shape.m
        out |= {(a + i * b) % shape.m for i in range(shape.k)}
    return sorted(out)
