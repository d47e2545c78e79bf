"""Drafts cut into section blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.binding import let
from corpusweave.functions.numerals import section_number
from corpusweave.functions.text import WS

# --- fixed values: header pattern -------------------------------------------

HEADER = rf"##{WS}+(סעיף|בסעיף){WS}+[(\'\"]*([א-ת]+|\p{{Nd}}+)[)\'\"]*"

# --- end of fixed values ----------------------------------------------------


def section_blocks(text: Column) -> Column:
    """Blocks of a draft: ``ARRAY<STRUCT<section, pos, text>>``, one per section.

    A block runs from its header to the next one, whatever that one names.
    Headers that name no number open no block; of several blocks with the same
    number the last counts.  All of it happens inside the row of the draft.
    """
    # what precedes the first header belongs to no block
    cut = F.filter(F.split(text, f"(?={HEADER})", -1), lambda p: p.rlike(f"^{HEADER}"))
    blocks = F.transform(
        cut,
        lambda p, i: F.struct(
            section_number(F.regexp_extract(p, f"^{HEADER}", 2)).alias("section"),
            i.alias("pos"),
            F.regexp_replace(p, f"^{HEADER}", "").alias("text"),
        ),
    )
    named = F.sort_array(F.filter(blocks, lambda b: b.section.isNotNull()))
    return let(named, _last_of_each)


def _last_of_each(blocks: Column) -> Column:
    """Last of every run of neighbours with the same section."""
    following = F.slice(F.transform(blocks, lambda b: b.section), 2, 2**31 - 1)
    kept = F.zip_with(
        blocks, following, lambda b, s: F.when(s.isNull() | (s != b.section), b)
    )
    return F.filter(kept, lambda b: b.isNotNull())


def split_blocks(drafts: DataFrame, text: str = "text") -> DataFrame:
    """One row per section block: the other columns plus ``section``, ``text``."""
    others = [c for c in drafts.columns if c != text]
    return drafts.select(*others, F.inline(section_blocks(F.col(text)))).drop("pos")
