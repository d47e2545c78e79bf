"""Reading versioned and nested JSON payloads inside their row."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from corpusweave.functions.text import TAG, squeeze

VERSIONED = "struct<versions: array<struct<language: string, text: variant>>>"


def json_depth(payload: Column) -> Column:
    """Upper bound of the bracket depth of a JSON text."""
    brackets = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(payload, r"\\.", ""), r'"[^"]*"', ""),
        r"[^\[\]]",
        "",
    )
    step = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest")),
        lambda acc, c: F.struct(
            (acc.now + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).alias("now"),
            F.greatest(acc.deepest, acc.now + F.when(c == "[", 1).otherwise(0)).alias("deepest"),
        ),
        lambda acc: acc.deepest,
    )
    return F.coalesce(step, F.lit(0))


def _level(items: Column) -> Column:
    """Open every list among the items by one level, in place."""
    return F.flatten(
        F.transform(
            items,
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )
    )


def nested_strings(tree: Column, depth: Column) -> Column:
    """Strings of nested lists, depth first; other leaves are dropped.

    ``tree`` is a VARIANT.  One fold step opens one level, so the number of
    steps is the depth of this very payload and the order is kept throughout.
    """
    opened = F.aggregate(F.sequence(F.lit(0), depth), F.array(tree), lambda acc, _: _level(acc))
    strings = F.filter(opened, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def flatten_payload(payload: Column) -> Column:
    """Strings of a JSON text of nested lists; a bare string is a list of one."""
    return nested_strings(F.try_parse_json(payload), json_depth(payload))


@pandas_udf(ArrayType(StringType()))
def _unescape_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [html.unescape(t) for t in texts], na_action="ignore")


def clean_segments(strings: Column) -> Column:
    """Clean every string of an array and drop the ones that end up empty.

    As for single texts, only arrays with an ``&`` in them travel to Python.
    """
    bare = F.transform(strings, lambda s: F.regexp_replace(s, TAG, ""))
    with_entities = F.exists(bare, lambda s: F.contains(s, F.lit("&")))
    decoded = F.coalesce(_unescape_all(F.when(with_entities, bare)), bare)
    return F.filter(F.transform(decoded, squeeze), lambda s: s != "")


def pick_version(payload: Column, language: str = "he") -> Column:
    """Text tree of the first version in ``language``: a VARIANT, null without one.

    The first version decides; a later one is not tried when it is empty.
    """
    versions = F.from_json(payload, VERSIONED).versions
    return F.get(F.filter(versions, lambda v: v.language == language), F.lit(0)).text
