"""Landed source payloads to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions import payloads as p
from corpusweave.functions.refs import build_ref

# --- fixed values -----------------------------------------------------------

LANGUAGE = "he"
LEGACY_FIELD = "$.he"
LINK = "array<struct<ref: string, anchorRef: string>>"

# --- end of fixed values ----------------------------------------------------


def source_segments(
    units: DataFrame,
    works: DataFrame,
    versioned: DataFrame,
    legacy: DataFrame,
    language: str = LANGUAGE,
) -> DataFrame:
    """Clean segments of every work of every unit, one array per (unit, work).

    ``units(corpus, unit)``, ``works(corpus, work, ref_prefix, …)``,
    ``versioned(ref, payload)`` and ``legacy(ref, payload)`` hold JSON.  The
    versioned payload counts when its first version in ``language`` yields any
    text, else the legacy payload.  A work found in neither keeps its row with
    an empty array.  Out: ``(corpus, unit, work, segments)``.
    """
    refs = units.join(works, "corpus").withColumn(
        "ref", build_ref(F.col("ref_prefix"), F.col("unit"))
    )
    depth = p.json_depth
    v, q = F.col("_versioned"), F.col("_legacy")
    picked = (
        refs.join(versioned.select("ref", F.col("payload").alias("_versioned")), "ref", "left")
        .join(legacy.select("ref", F.col("payload").alias("_legacy")), "ref", "left")
        .select(
            "corpus",
            "unit",
            "work",
            p.clean_segments(p.nested_strings(p.pick_version(v, language), depth(v))).alias("_a"),
            p.clean_segments(
                p.nested_strings(
                    F.try_variant_get(F.try_parse_json(q), LEGACY_FIELD, "variant"), depth(q)
                )
            ).alias("_b"),
        )
    )
    none = F.array().cast("array<string>")
    return picked.select(
        "corpus",
        "unit",
        "work",
        F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.coalesce("_b", none)).alias("segments"),
    )


def number_payload_segments(sources: DataFrame) -> DataFrame:
    """``(corpus, unit, work, seg_no, text)`` from segment arrays, numbered in their row."""
    return sources.select(
        "corpus", "unit", "work", F.posexplode("segments").alias("_pos", "text")
    ).select("corpus", "unit", "work", (F.col("_pos") + 1).alias("seg_no"), "text")


def missing_works(sources: DataFrame) -> DataFrame:
    """Works that were found in no payload."""
    return sources.where(F.size("segments") == 0).select("corpus", "unit", "work")


def links_from_payloads(payloads: DataFrame) -> DataFrame:
    """``(corpus, unit, ref, anchor_ref)`` from JSON lists of links.

    A missing or broken list means zero links, not an error.
    """
    return payloads.select(
        "corpus", "unit", F.inline(F.from_json("payload", LINK))
    ).withColumnRenamed("anchorRef", "anchor_ref")
