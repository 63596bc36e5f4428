"""Hash-derived values. md5 is used throughout, so any engine with md5 can reproduce them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS60 = float(1 << 60)


def _as_text(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash60(*parts) -> Column:
    """60-bit non-negative integer from the first 15 hex digits of md5(parts joined by '|')."""
    return F.conv(F.substring(F.md5(_as_text(parts)), 1, 15), 16, 10).cast("bigint")


def unit_draw(*parts) -> Column:
    """Reproducible draw in [0, 1) for the given key parts (column or literal)."""
    return hash60(*parts).cast("double") / F.lit(_BITS60)


def short_label(text: Column) -> Column:
    """16-hex-digit label of a text."""
    return F.substring(F.md5(text), 1, 16)


def stable_id(name: Column) -> Column:
    """60-bit id of an entity name."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def multiset_sums(text: Column) -> Column:
    """Aggregate that identifies a multiset of texts: three order-free sums of 32-bit parts of their md5.

    The sums are plain aggregates, so a group of any size is combined map-side and never has to be
    collected and sorted in one place. A sum holds for groups of up to 2**31 texts.
    """
    parts = [F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("bigint") for start in (1, 9, 17)]
    return F.concat_ws("|", *[F.sum(p).cast("string") for p in parts])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
