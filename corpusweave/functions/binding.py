"""Working out an expression once where its value is used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once and for all.

    A filter on a plain computed column is pushed below it, which works the
    expression out a second time, again for every layer under it.  A filter on
    the output of a generator stays above it.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
