"""Text clean-up, counting and extraction."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------

# every character that Unicode-aware text tools treat as white space: the
# property and the four information separators
WHITE_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WHITE_SPACE_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TAG = r"<[^>]+>"
TOKENS_PER_WORD = 1.8
PRICE_PER_1000_CHARS = 0.18
PCM_BYTES_PER_SECOND = 48000
FENCE = r"(?s)```text\n(.*?)\n```"

# --- end of fixed values ----------------------------------------------------

WS = f"[{WHITE_SPACE}]"


@pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip(text: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Trim, and turn each inner run of white space into one blank."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def clean_markup(text: Column) -> Column:
    """Markup to plain text: tags vanish first, then entities are decoded,
    then white space is squeezed.  Null becomes the empty string.

    Spark has no built-in for the complete entity table.  Only texts with an
    ``&`` travel to Python for it; for the others a null does.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "")
    decoded = _unescape(F.when(F.contains(text, F.lit("&")), bare))
    return squeeze(F.coalesce(decoded, bare))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for empty or null text."""
    return F.when(
        F.length(strip(text)) > 0, F.size(F.split(strip(text), f"{WS}+", -1))
    ).otherwise(0)


def token_estimate(words: Column) -> Column:
    return F.floor(words * F.lit(TOKENS_PER_WORD)).cast("bigint")


def speech_cost(chars: Column, price_per_1000: float = PRICE_PER_1000_CHARS) -> Column:
    return chars / F.lit(1000) * F.lit(price_per_1000)


def size_mb(payload: Column) -> Column:
    return F.octet_length(payload) / F.lit(1024) / F.lit(1024)


def pcm_seconds(payload: Column) -> Column:
    """Play time of 16-bit mono audio at 24 kHz."""
    return F.octet_length(payload) / F.lit(PCM_BYTES_PER_SECOND)


def fenced_block(text: Column, pattern: str = FENCE) -> Column:
    """Group 1 of the first match, stripped; null when there is none."""
    return F.when(
        F.regexp_like(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, 1))
    )
