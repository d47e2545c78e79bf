"""Versioned artefacts: history, latest version, what is cached and what is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.naming import history_name, latest_name


def _newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key.  Each task keeps its own newest row of a key before they
    meet, so a key with very many versions sends one row per task."""
    place = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def version_history(
    artefacts: DataFrame, keys: list[str], base: Column, extension: str, tiebreak: str
) -> DataFrame:
    """History copies with their file names.

    Names have a resolution of one second, so of the versions of a key within
    a second the last one stays, as a file of that name would.
    """
    stamped = artefacts.withColumn("_second", F.date_trunc("second", "ts"))
    kept = _newest(stamped, [*keys, "_second"], ["ts", tiebreak]).drop("_second")
    ext = F.lit(extension)
    return kept.withColumn("history_name", history_name(base, F.col("ts"), ext)).withColumn(
        "latest_name", latest_name(base, ext)
    )


def latest_versions(artefacts: DataFrame, keys: list[str], tiebreak: str) -> DataFrame:
    """Latest version of every key; ``tiebreak`` settles equal times."""
    return _newest(artefacts, keys, ["ts", tiebreak])


def _readable(cached: DataFrame, keys: list[str], text: str | None) -> DataFrame:
    usable = cached if text is None else cached.where(F.col(text).isNotNull())
    return usable.select(*keys).distinct()


def cached_needed(
    needed: DataFrame,
    cached: DataFrame,
    keys: list[str],
    text: str | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Needed units that have a readable cached artefact; none when overwriting."""
    if overwrite:
        return needed.where(F.lit(False))
    return needed.join(_readable(cached, keys, text), keys, "left_semi")


def missing_needed(
    needed: DataFrame,
    cached: DataFrame,
    keys: list[str],
    text: str | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Needed units to make: no cached artefact, an unreadable one, or overwriting."""
    if overwrite:
        return needed
    return needed.join(_readable(cached, keys, text), keys, "left_anti")
