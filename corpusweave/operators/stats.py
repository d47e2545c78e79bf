"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import speech_cost, token_estimate, word_count


def corpus_stats(segments: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Segments, characters, words and estimated tokens per group, and in total.

    Groups are summed first; the total row is rolled up from those few rows,
    so the texts are not expanded for it.
    """
    per_group = segments.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum(F.length(text)).alias("c"),
        F.sum(word_count(F.col(text))).alias("w"),
    )
    return (
        per_group.rollup(group)
        .agg(
            F.grouping(group).cast("int").alias("is_total"),
            F.sum("n").alias("segments"),
            F.sum("c").alias("chars"),
            F.sum("w").alias("words"),
        )
        .withColumn("tokens", token_estimate(F.col("words")))
    )


def script_costs(scripts: DataFrame, text: Column) -> DataFrame:
    """Add ``chars``, ``words`` and ``cost`` of speaking each script."""
    return (
        scripts.withColumn("chars", F.length(text))
        .withColumn("words", word_count(text))
        .withColumn("cost", speech_cost(F.col("chars")))
    )
