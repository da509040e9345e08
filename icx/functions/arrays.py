"""Small array helpers that keep per-row work O(n) inside the JVM.

`let` binds an expensive value once. Catalyst collapses adjacent projections, so an
array computed in one `select` and referenced inside a lambda of the next would be
re-evaluated for every element; routing it through a one-element `transform` keeps it
a single evaluation per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and pass it to `body` as a lambda variable."""
    return F.transform(F.array(value), body).getItem(0)


def at(arr: Column, idx: Column | int) -> Column:
    """0-based element access that yields null outside the array (ANSI-safe)."""
    return F.get(arr, idx if isinstance(idx, Column) else F.lit(idx))

