"""Options of the two kinds of index, as strings like those of a CREATE INDEX statement."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from siftlake.functions.shape import Shape

#: Words that say yes and no, in any case.
YES, NO = ("y", "t", "1", "on", "yes", "true"), ("n", "f", "0", "off", "no", "false")
#: Bytes from which a filter can't be written, and over which none can be asked for.
MOST_BYTES = 65_535


def parse_int(options: Mapping[str, str], name: str) -> int:
    """0 if missing; ValueError if it isn't a whole number."""
    if (value := options.get(name)) is None:
        return 0
    try:
        return int(str(value).strip())
    except ValueError as e:
        raise ValueError(f"{name} must be a whole number, not {value!r}") from e


def parse_bool(value: str | None, default: bool = False) -> bool:
    word = (value or "").strip().lower()
    return True if word in YES else False if word in NO else default


@dataclass(frozen=True)
class ChunkOptions:
    """m, n and k give the number of index entries a row; without all three rows aren't estimated (ratio 0)."""

    ratio: float = 0.0
    gated: bool = False
    zero_target: str = "none"

    @classmethod
    def parse(cls, options: Mapping[str, str]) -> ChunkOptions:
        m, n, k = (parse_int(options, x) for x in ("numberOfBits", "numberOfItems", "numberOfFunctions"))
        ratio = Shape(m, k).entries_per_row(n) if min(m, n, k) > 0 else 0.0
        return cls(ratio, parse_bool(options.get("usePrimaryFilter")))


@dataclass(frozen=True)
class SliceOptions:
    bits: int
    zero_target: str = "all"

    @classmethod
    def parse(cls, options: Mapping[str, str]) -> SliceOptions:
        if (bits := parse_int(options, "numberOfBits")) <= 0:
            raise ValueError("numberOfBits must be positive")
        return cls(bits)


def check_column(kind: str) -> None:
    """Only a regular column of single values can be indexed."""
    if kind in ("clustering", "complex", "counter", "partition_key", "primary_key", "static"):
        raise ValueError(f"a {kind} column can't be indexed")
