"""Joins on a key that one group may fill: both sides are dealt over parts of that key.

The large side has a spread (part) of its own rows. The small side, aggregated by
key, notes in one long the parts in which the key occurs, and is copied to
those only: a key with a few rows stays a few rows, and a third of all rows
under one key is dealt over 64 tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a key: as many as a long has bits.
SPREADS = 64


def bit(place: Column) -> Column:
    """A long with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def spread_of(*columns) -> Column:
    """The part that a row of the large side belongs to."""
    return F.pmod(F.xxhash64(*columns), F.lit(SPREADS)).cast("int")


def parts_seen(spread: Column) -> Column:
    """Aggregate: the parts in which a key occurs."""
    return F.bit_or(bit(spread))


def each_part(seen: str) -> Column:
    """A row for every part of :func:`parts_seen`."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SPREADS - 1)), lambda k: F.getbit(seen, k) == 1))
