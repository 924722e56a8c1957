"""Helpers for large Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: as a lambda variable it is not copied into each of its uses."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
