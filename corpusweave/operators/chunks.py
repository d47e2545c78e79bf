"""Chunk tables: cutting texts and putting payloads together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.binding import settle
from corpusweave.functions.chunking import CHUNK_LIMIT, chunks
from corpusweave.operators.segments import joined_parts

# Bytes per part of a re-assembled artefact.
PART_BYTES = 64 << 20


def chunk_texts(
    texts: DataFrame, keys: list[str], text: str = "text", limit: int = CHUNK_LIMIT
) -> DataFrame:
    """``(keys…, chunk_no, chunk)``, numbered from 1.  No shuffle."""
    return texts.select(
        *keys, F.posexplode(chunks(F.col(text), limit)).alias("_pos", "chunk")
    ).select(*keys, (F.col("_pos") + 1).alias("chunk_no"), "chunk")


def chunk_stats(
    texts: DataFrame, keys: list[str], text: str = "text", limit: int = CHUNK_LIMIT
) -> DataFrame:
    """Number, total and largest size of the chunks of each text.  No shuffle."""
    cut = settle(
        texts.select(*keys, text), _sizes=F.transform(chunks(F.col(text), limit), F.length)
    )
    return cut.where(F.size("_sizes") > 0).select(
        *keys,
        F.size("_sizes").cast("bigint").alias("n_chunks"),
        F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total_chars"),
        F.array_max("_sizes").alias("max_chars"),
    )


def reassemble(
    payloads: DataFrame, keys: list[str], payload: str = "payload", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Payloads appended in chunk order: ``(keys…, part_no, n_parts, payload)``.

    Text or binary.  ``chunk_no`` starts at 1 and is unique in an artefact; one of
    more than ``part_bytes`` bytes comes as several parts, in order, so that a
    group is bounded whatever the size of an artefact.
    """
    return joined_parts(payloads, keys, "chunk_no", payload, part_bytes)
