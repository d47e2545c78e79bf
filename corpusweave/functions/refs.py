"""Reference strings: building them and reading them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.dimensions import BASE_WORK

MARK = "\u0001"


def build_ref(prefix: Column, unit: Column) -> Column:
    """``"{prefix}.{unit}"`` with blanks as underscores."""
    return F.replace(
        F.concat_ws(".", prefix, unit.cast("string")), F.lit(" "), F.lit("_")
    )


def base_section(ref: Column, corpus: Column, unit: Column) -> Column:
    """Section in the first ``"{base work}, {corpus} {unit}:{section}"`` of ``ref``.

    Deeper levels and range ends are ignored; null when there is no match.
    """
    head = F.concat(F.lit(f"{BASE_WORK}, "), corpus, F.lit(" "), unit.cast("string"), F.lit(":"))
    # the head differs per row: marking it keeps the pattern itself a literal
    marked = F.replace(ref, head, F.lit(MARK))
    return F.nullif(F.regexp_extract(marked, f"{MARK}([0-9]+)", 1), F.lit("")).try_cast("int")
