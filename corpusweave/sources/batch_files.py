"""Request and result files of batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that give the order of result lines.
LINE_ORDER = ["file", "block", "line"]


def write_requests(requests: DataFrame, path: str) -> None:
    """Write the requests as JSON lines; characters outside ASCII stay as they are."""
    requests.where(F.col("request").isNotNull()).select(
        F.col("request").alias("value")
    ).write.text(path)


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines with the columns of ``LINE_ORDER``.

    A split of a file is read by one task from start to end, so file, start of
    the split and the row counter give the order of the lines in their file.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
