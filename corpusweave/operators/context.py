"""Context documents: all sources of a unit, in order, as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.templates import fill
from corpusweave.operators.segments import byte_parts, number_rows

# --- fixed values: document format ------------------------------------------

RULE = "=" * 41
UNIT_HEADER = "\n\n" + RULE + "\n=== סימן {unit} ===\n" + RULE + "\n\n"
WORK_HEADER = "--- {work} (סימן {unit}) ---\n\n"
ENTRY = "[{number}] {text}\n\n"

# --- end of fixed values ----------------------------------------------------


# Bytes of source text per part of a context document.
PART_BYTES = 1 << 20


def assemble_context(
    units: DataFrame,
    works: DataFrame,
    segments: DataFrame,
    position: str = "position",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Context documents as ``(corpus, unit, is_target, part_no, n_parts, text)``.

    ``units(corpus, unit, is_target)``, ``works(corpus, work, work_ord,
    is_core)``, ``segments(corpus, unit, work, <position>, text)`` with a
    position of any orderable type, unique in (corpus, unit, work).  Empty
    segments are dropped before numbering; a context-only unit takes its core
    works only.  A unit without any entry is its header alone.

    A document comes in parts of about ``part_bytes`` bytes of source text, each
    entry whole in one of them; the document is its parts in order.  Which
    segments belong to a document, their numbers, places and parts are worked
    out on keys and sizes.  The texts join them once they are known.
    """
    unit_no = F.col("unit").cast("string")
    keyed = segments.where(F.col("text") != "").select(
        "corpus", "unit", "work", position, F.octet_length("text").cast("bigint").alias("_size")
    )
    taken = (
        keyed.join(works.select("corpus", "work", "work_ord", "is_core"), ["corpus", "work"])
        .join(units.select("corpus", "unit", "is_target"), ["corpus", "unit"])
        .where(F.col("is_target") | F.col("is_core"))
        .drop("is_core", "is_target")
    )
    unit = ["corpus", "unit"]
    # along the whole unit, then within its works: a unit has few of them
    ranked = number_rows(taken, unit, ["work_ord", position], "rank", size="_size", before="_before")
    starts = ranked.groupBy(*unit, "work").agg(F.min("rank").alias("first"))
    dealt = byte_parts(
        ranked.join(starts, [*unit, "work"]).withColumn("seg_no", F.col("rank") - F.col("first") + 1),
        unit,
        "_before",
        part_bytes,
    ).select(*unit, "work", position, "seg_no", "rank", "part_no", "n_parts")
    title = fill(WORK_HEADER, work=F.col("work"), unit=unit_no)
    entry = fill(ENTRY, number=F.col("seg_no").cast("string"), text=F.col("text"))
    bodies = (
        dealt.join(segments.select(*unit, "work", position, "text"), [*unit, "work", position])
        .where(F.col("text") != "")
        .select(
            *unit,
            "part_no",
            "n_parts",
            "rank",
            F.concat(F.when(F.col("seg_no") == 1, title).otherwise(""), entry).alias("piece"),
        )
        .groupBy(*unit, "part_no", "n_parts")
        .agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY rank)").alias("body"))
    )
    part_no = F.coalesce("part_no", F.lit(1))
    header = F.when(part_no == 1, fill(UNIT_HEADER, unit=unit_no)).otherwise("")
    return (
        units.select(*unit, "is_target")
        .join(bodies, unit, "left")
        .select(
            *unit,
            "is_target",
            part_no.alias("part_no"),
            F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
            F.concat(header, F.coalesce("body", F.lit(""))).alias("text"),
        )
    )
