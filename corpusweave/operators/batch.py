"""Results of batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusweave.functions.binding import settle

# --- fixed values -----------------------------------------------------------

RESULT = (
    "struct<custom_id: string, response: struct<status_code: int, body: struct<"
    "choices: array<struct<message: struct<content: string>>>>>>"
)
DONE = "completed"
RUNNING = ("validating", "in_progress")

# --- end of fixed values ----------------------------------------------------


# Why a line gives no content.
BROKEN, NO_ID, NO_CONTENT = "broken line", "no custom id", "no content"


def parse_results(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``custom_id``, ``content``, ``is_usable`` and ``error`` to result lines.

    Blank lines are dropped.  Every other line stays: one that can't be read, has
    no custom id or carries no choice says so in ``error`` and has a null content.
    """
    others = [c for c in lines.columns if c != value]
    choices = F.col("_result.response.body.choices")
    parsed = settle(
        lines.where(F.trim(value) != ""),
        _result=F.from_json(
            value,
            f"struct<{RESULT[7:-1]}, _broken: string>",
            {"columnNameOfCorruptRecord": "_broken"},
        ),
    )
    broken = F.col("_result").isNull() | F.col("_result._broken").isNotNull()
    named = F.coalesce("_result.custom_id", F.lit("")) != ""
    good = ~broken & named & choices.isNotNull()
    error = F.when(broken, BROKEN).when(~named, NO_ID).when(choices.isNull(), NO_CONTENT)
    return parsed.select(
        *others,
        F.when(~broken & named, F.col("_result.custom_id")).alias("custom_id"),
        F.when(good, F.get(choices, F.lit(0)).getField("message").getField("content")).alias("content"),
        good.alias("is_usable"),
        error.alias("error"),
        F.when(error.isNotNull(), F.col(value)).alias("line_text"),
    )


def result_errors(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The lines of :func:`parse_results` that give no content: ``(keep…, custom_id, error, line_text)``."""
    return parsed.where(F.col("error").isNotNull()).select(*keep, "custom_id", "error", "line_text")


def observed(parsed: DataFrame, observation: Observation) -> DataFrame:
    """``parsed`` with its lines counted, all and by error, by the job that consumes it."""
    counts = [
        F.count_if(F.col("error") == error).alias(name)
        for name, error in (("broken", BROKEN), ("no_id", NO_ID), ("no_content", NO_CONTENT))
    ]
    return parsed.observe(
        observation, F.count(F.lit(1)).alias("lines"), F.count_if("is_usable").alias("usable"), *counts
    )


def first_usable(
    parsed: DataFrame, order: list[str], keys: tuple[str, ...] = ("custom_id",)
) -> DataFrame:
    """Content of the first usable line per key, in ``order``.

    Every task keeps only its own first line of a key before they meet, so a
    key with very many lines is no hot spot.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    return (
        parsed.where("is_usable")
        .select(*keys, *order, "content")
        .withColumn("_place", F.row_number().over(place))
        .where("_place = 1")
        .select(*keys, "content")
    )


def join_results(
    requests: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("custom_id",)
) -> DataFrame:
    """Requests against results: ``state`` is complete, pending or orphan.

    A custom id names a unit but not its corpus: where several jobs were sent,
    ``keys`` must hold the job too.
    """
    asked = requests.withColumn("_asked", F.lit(True))
    came = results.withColumn("_came", F.lit(True))
    return (
        asked.join(came, list(keys), "full_outer")
        .withColumn(
            "state",
            F.when(F.col("_asked").isNull(), "orphan")
            .when(F.col("_came").isNull(), "pending")
            .otherwise("complete"),
        )
        .drop("_asked", "_came")
    )


def route_status(status: Column, has_output: Column) -> Column:
    """``keep``, ``pending`` or ``failed`` for a batch status."""
    return (
        F.when((status == DONE) & has_output, "keep")
        .when(status.isin(*RUNNING), "pending")
        .otherwise("failed")
    )
