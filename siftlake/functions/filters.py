"""Bloom filters as columns. A filter is BINARY: 64-bit words, each big-endian; bit i is bit i mod 64 of word i div 64.

So a byte of the filter at position p (bits 8 p to 8 p + 7) stands at offset (p div 8) * 8 + 7 - p mod 8.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.options import MOST_BYTES
from siftlake.functions.shape import Shape


#: Fixed value: the bits of each byte code.
_BITS_OF_CODE = [[b for b in range(8) if c >> b & 1] for c in range(256)]


def once(value: Column, f) -> Column:
    """``f(value)``, with the value computed once a row, however often and in whatever lambda ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _range(n: Column | int) -> Column:
    """0 to n - 1; empty for 0, where sequence() would count down."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _shifted(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def byte_at(data: Column, offset: Column) -> Column:
    """The byte at a 0-based offset as 0 to 255."""
    return F.conv(F.hex(F.substring(data, offset + 1, F.lit(1))), 16, 10).cast("int")


def words_of_bits(bits: Column, shape: Shape) -> Column:
    """Words of an array of bits, in the row."""
    put = lambda w: lambda acc, b: F.when(F.shiftright(b, 6) == w, acc.bitwiseOR(_shifted(b))).otherwise(acc)  # noqa: E731  a shift counts modulo 64
    return once(bits, lambda bs: F.transform(_range(shape.words), lambda w: F.aggregate(bs, F.lit(0).cast("long"), put(w))))


def encode_words(words: Column) -> Column:
    """BINARY of an array of words."""
    return F.unhex(F.concat_ws("", F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0"))))


def decode_words(data: Column) -> Column:
    """Words of a filter; a trailing part of a word is left out. Halves are joined, since a whole word overflows conv."""
    half = lambda w, at: F.conv(F.hex(F.substring(data, w * 8 + at, F.lit(4))), 16, 10).cast("long")
    return F.transform(_range((F.octet_length(data) / 8).cast("int")), lambda w: F.shiftleft(half(w, 1), 32).bitwiseOR(half(w, 5)))


def filter_of_bits(bits: Column, shape: Shape) -> Column:
    return encode_words(words_of_bits(bits, shape))


def hex_string(data: Column) -> Column:
    """0x and upper-case digits."""
    return F.concat(F.lit("0x"), F.hex(data))


def from_hex(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, "^0x", ""))


def bits_of(data: Column) -> Column:
    """Ascending bits of a filter."""
    known = F.from_json(F.lit(json.dumps(_BITS_OF_CODE)), "array<array<int>>")  # a constant
    return F.flatten(F.transform(codes(data), lambda c, p: F.transform(known[c], lambda b: (p * 8 + b).cast("long"))))


def codes(data: Column) -> Column:
    """Bytes by position, the low byte of each word first; a trailing part of a word is left out; null is empty."""
    each = lambda w: F.array(*[F.shiftright(w, 8 * i).bitwiseAND(255).cast("int") for i in range(8)])
    return F.flatten(F.transform(once(data, decode_words), each))


def cardinality(data: Column) -> Column:
    """Bits set."""
    return F.aggregate(decode_words(data), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w))


def bf_contains(candidate: Column, target: Column) -> Column:
    """Whether every bit of ``target`` is in ``candidate``, byte by byte.

    A null target is in everything; a null candidate holds only that. A shorter candidate holds no longer target,
    even if its excess is zero; what a candidate has beyond the target is ignored.
    """
    inside = F.forall(_range(F.octet_length(target)), lambda i: byte_at(candidate, i).bitwiseAND(byte_at(target, i)) == byte_at(target, i))
    return F.when(candidate.isNull(), target.isNull()).when(target.isNull(), F.lit(True)).when(F.octet_length(candidate) < F.octet_length(target), F.lit(False)).otherwise(inside)


def bf_contains_words(candidate: Column, target: bytes) -> Column:
    """The same for a constant target of whole words and filters of one shape: eight bytes a step, no loop over bytes."""
    words = [int.from_bytes(target[i : i + 8], "big", signed=True) for i in range(0, len(target), 8)]

    def inside(data: Column) -> Column:
        tests = F.lit(True)
        for w, word in enumerate(words):
            if word:
                half = lambda at, w=w: F.conv(F.hex(F.substring(data, w * 8 + at, 4)), 16, 10).cast("long")
                have = F.shiftleft(half(1), 32).bitwiseOR(half(5))
                tests = tests & (have.bitwiseAND(F.lit(word)) == F.lit(word))
        return F.coalesce(F.octet_length(data) >= len(target), F.lit(False)) & tests

    return F.exists(F.array(candidate), inside)  # a filter made in the row is made once, not for each test


def adjust(target: bytes, shape: Shape) -> bytes:
    """A target as long as the shape's filters: shorter ones end in zeros, longer ones raise."""
    size = shape.words * 8
    if len(target) > size:
        raise ValueError(f"a target of {len(target)} bytes doesn't fit {shape.m} bits")
    return target.ljust(size, b"\0")


def bits_of_bytes(target: bytes) -> list[int]:
    """Ascending bits of a filter, on the driver."""
    whole = len(target) // 8 * 8
    return sorted(w // 8 * 64 + b for w in range(0, whole, 8) for b in range(64) if int.from_bytes(target[w : w + 8], "big") >> b & 1)


def bytes_of_bits(bits, shape: Shape) -> bytes:
    words = [0] * shape.words
    for b in bits:
        words[b // 64] |= 1 << (b % 64)
    return b"".join(w.to_bytes(8, "big") for w in words)


def _same_size(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("bitmaps differ in size")).cast("array<long>"))


def word_or(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


def word_and(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def word_xor(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def is_set(words: Column, bit: Column) -> Column:
    """Whether a bit is set: false beyond the end, an error if negative."""
    there = F.coalesce(F.getbit(F.try_element_at(words, (bit / 64).cast("int") + 1), (bit % 64).cast("int")) == 1, F.lit(False))
    return F.when(bit < 0, F.raise_error(F.lit("a bit can't be negative")).cast("boolean")).otherwise(there)


def with_bit(words: Column, bit: Column, on: bool = True) -> Column:
    """Words with one bit set or cleared; words are added where a set bit needs them."""
    at = (bit / 64).cast("int")
    grown = F.concat(words, F.array_repeat(F.lit(0).cast("long"), F.greatest(at + 1 - F.size(words), F.lit(0)))) if on else words
    mask = _shifted(bit % 64)
    change = lambda w, i: F.when(i == at, w.bitwiseOR(mask) if on else w.bitwiseAND(F.bitwise_not(mask))).otherwise(w)
    return F.when(bit < 0, F.raise_error(F.lit("a bit can't be negative")).cast("array<long>")).otherwise(F.transform(grown, change))


def set_bits(words: Column, limit: int | None = None) -> Column:
    """Ascending set bits below ``limit``."""
    top = F.size(words) * 64
    return F.filter(_range(top if limit is None else F.least(top, F.lit(limit))), lambda i: is_set(words, i))


def checked(data: Column, shape: Shape | None = None) -> Column:
    """The filter itself; an error if it is too long to be stored, or isn't whole words of the shape."""
    size = F.octet_length(data)
    out = F.when(size >= MOST_BYTES, F.raise_error(F.lit("filter of 64K or more")).cast("binary"))
    if shape is not None:
        out = out.when(size != shape.words * 8, F.raise_error(F.lit("filter isn't of the shape's words")).cast("binary"))
    return out.otherwise(data)


def register(spark) -> None:
    """The SQL function bf_contains(candidate, target), without Python in the plan."""
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION bf_contains(candidate BINARY, target BINARY) RETURNS BOOLEAN RETURN
      CASE WHEN candidate IS NULL THEN target IS NULL WHEN target IS NULL THEN true
           WHEN length(candidate) < length(target) THEN false WHEN length(target) = 0 THEN true
           ELSE forall(sequence(1, length(target)), i ->
             (CAST(conv(hex(substring(candidate, i, 1)), 16, 10) AS INT) & CAST(conv(hex(substring(target, i, 1)), 16, 10) AS INT))
             = CAST(conv(hex(substring(target, i, 1)), 16, 10) AS INT)) END""")
