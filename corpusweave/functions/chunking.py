"""Cutting long texts into size-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.text import WS, strip

# --- fixed values: chunk limits of the speech services ----------------------

CHUNK_LIMIT = 4000
SMALL_CHUNK_LIMIT = 2000
JOINT = "\n\n"
SENTENCE_END = f"(?<=[.!?]){WS}+"

# --- end of fixed values ----------------------------------------------------


def _piece(text: Column, cost: int, flush) -> Column:
    return F.struct(
        text.alias("text"), F.lit(cost).alias("cost"), F.coalesce(flush, F.lit(False)).alias("flush")
    )


def _long_paragraph(paragraph: Column, limit: int) -> Column:
    """Sentences of a paragraph; a sentence over the limit becomes its words."""
    bits = F.flatten(
        F.transform(
            F.split(paragraph, SENTENCE_END, -1),
            lambda s: F.when(F.length(s) > limit, F.split(s, " ", -1)).otherwise(F.array(s)),
        )
    )
    return F.transform(bits, lambda bit, i: _piece(bit, 1, i == 0))


def pieces(text: Column, limit: int) -> Column:
    """Ordered pieces to pack: paragraphs, or the parts of long paragraphs.

    ``cost`` is what a piece adds besides its own length, ``flush`` closes
    the open chunk first.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: p != "")
    return F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.when(F.length(p) > limit, _long_paragraph(p, limit)).otherwise(
                F.array(_piece(p, 2, F.lit(False)))
            ),
        )
    )


def chunks(text: Column, limit: int = CHUNK_LIMIT) -> Column:
    """Text packed greedily into chunks, as ``ARRAY<STRING>``.

    A text within the limit is returned untouched.  Chunks always join their
    pieces with a blank line although only one character is counted for a
    sentence or word, so a chunk may exceed the limit; and a first piece that
    nearly fills the limit is preceded by an empty chunk.  Both are part of
    the rule.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("size"),
    )

    def pack(acc, piece):
        flushed = piece.flush & acc.open.isNotNull()
        done = F.when(flushed, F.array_append(acc.done, acc.open)).otherwise(acc.done)
        open_ = F.when(~flushed, acc.open)
        size = F.when(flushed, F.lit(0)).otherwise(acc.size)
        full = size + F.length(piece.text) + piece.cost > limit
        return F.struct(
            F.when(full, F.array_append(done, F.coalesce(open_, F.lit("")))).otherwise(done)
            .alias("done"),
            F.when(full | open_.isNull(), piece.text)
            .otherwise(F.concat(open_, F.lit(JOINT), piece.text))
            .alias("open"),
            F.when(full, F.length(piece.text))
            .otherwise(size + F.length(piece.text) + piece.cost)
            .alias("size"),
        )

    packed = F.aggregate(
        pieces(text, limit),
        start,
        pack,
        lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(
            F.array_append(acc.done, acc.open)
        ),
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)
