"""Letter numerals from 1 to 999, both ways, as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.binding import let

# --- fixed values -----------------------------------------------------------

UNITS = ["", "א", "ב", "ג", "ד", "ה", "ו", "ז", "ח", "ט"]
TENS = ["", "י", "כ", "ל", "מ", "נ", "ס", "ע", "פ", "צ"]
HUNDREDS = ["", "ק", "ר", "ש", "ת", "תק", "תר", "תש", "תת", "תתק"]
FIFTEEN = "טו"
SIXTEEN = "טז"
MAX_NUMERAL = 999

# --- end of fixed values ----------------------------------------------------


def _pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def letters(number: Column) -> Column:
    """Numeral without quote marks; null outside 1..999."""
    below_100 = number % 100
    tail = (
        F.when(below_100 == 15, F.lit(FIFTEEN))
        .when(below_100 == 16, F.lit(SIXTEEN))
        .otherwise(
            F.concat(_pick(TENS, F.floor(below_100 / 10)), _pick(UNITS, number % 10))
        )
    )
    return F.when(
        number.between(1, MAX_NUMERAL), F.concat(_pick(HUNDREDS, F.floor(number / 100)), tail)
    )


def numeral(number: Column) -> Column:
    """Numeral with its mark: ``'`` after one letter, ``"`` before the last of several."""
    return F.regexp_replace(
        F.regexp_replace(letters(number), "^(.)$", "$1'"), "^([^']+)([^'])$", '$1"$2'
    )


def letters_value(token: Column) -> Column:
    """Number written by ``token`` in the canonical form of :func:`letters`, else null.

    The letters are summed and the sum is spelled again: only the canonical
    spelling survives, so no dictionary of all forms is needed.
    """
    alphabet = "".join(UNITS + TENS) + "".join(h for h in HUNDREDS if len(h) == 1)
    worth = [*range(1, 10), *range(10, 100, 10), *range(100, 500, 100)]
    values = F.array(*[F.lit(w) for w in worth])
    total = F.aggregate(
        F.split(token, ""),
        F.lit(0),
        # another letter adds null, which no spelling equals
        lambda acc, c: acc + F.get(values, F.instr(F.lit(alphabet), c) - 1),
    )
    spelled = let(total, lambda n: F.when(letters(n) == token, n))
    return F.when(F.length(token).between(1, 5), spelled)


def section_number(token: Column) -> Column:
    """Number of a section token: canonical letters, or digits without leading zeros."""
    digits = F.regexp_extract(token, r"^([1-9][0-9]{0,8})$", 1)
    return F.coalesce(
        letters_value(token).cast("int"), F.nullif(digits, F.lit("")).try_cast("int")
    )
