"""Batch results that arrive as files while nobody waits for them.

::

    <store>/arrivals/batch_id=<n>/…  the lines of a micro-batch, parsed
    <store>/counts/<n>.json          how many lines it had, and of which kinds
    <store>/results/…                one row per request, a snapshot store

A micro-batch owns its folder and overwrites it when it is replayed; its
number is published with the snapshot, so a replay is merged once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusweave.operators.batch import observed, parse_results, result_errors
from corpusweave.sources import folders, snapshots

KEYS = ["job", "custom_id"]
PLACE = ["batch_id", "file", "block", "line"]
ARRIVALS = (
    "file string, block bigint, job string, line bigint, custom_id string, content string, "
    "is_usable boolean, error string, line_text string, batch_id bigint"
)
# One row per request: whether it was asked for, its first usable content and where that
# came, and how many lines, usable or not, have come for it.
REQUESTS = (
    "job string, custom_id string, asked boolean, content string,"
    "place struct<batch_id: bigint, file: string, block: bigint, line: bigint>,"
    "n_usable bigint, n_failed bigint"
)
JOB_FOLDER = r"/job=([^/]+)/"
BUCKETS = 16


def result_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of result lines from files landing in a folder; those under ``job=<job>`` know
    the job they answer, others have the empty one."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    file = F.col("_metadata.file_path")
    return reader.load(path).select(
        "value",
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_extract(file, JOB_FOLDER, 1).alias("job"),
    )


def _one_row_per_request(rows: DataFrame) -> DataFrame:
    """Requests and arrivals of a key together; the first usable line counts.

    Keys and places are reduced first, the content of the first place joins them:
    no content is carried through a sort.
    """
    reduced = rows.groupBy(*KEYS).agg(
        F.max("asked").alias("asked"),
        F.min("place").alias("place"),
        F.sum("n_usable").alias("n_usable"),
        F.sum("n_failed").alias("n_failed"),
    )
    found = rows.where("place is not null").select(*KEYS, "place", "content")
    joined = reduced.join(found, [*KEYS, "place"], "left")
    return joined.select(*KEYS, "asked", "content", "place", "n_usable", "n_failed")


def _arrived(parsed: DataFrame) -> DataFrame:
    good = F.col("is_usable")
    return parsed.where("custom_id is not null").select(
        *KEYS,
        F.lit(False).alias("asked"),
        F.when(good, F.col("content")).alias("content"),
        F.when(good, F.struct(*PLACE)).alias("place"),
        good.cast("bigint").alias("n_usable"),
        (~good).cast("bigint").alias("n_failed"),
    )


def register_requests(requests: DataFrame, store: str) -> None:
    """Enter ``requests(job, custom_id)`` into the store: pending until a result comes."""
    asked = requests.select(
        *KEYS,
        F.lit(True).alias("asked"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast(f"struct<{', '.join(f'{c}: {"string" if c == "file" else "bigint"}' for c in PLACE)}>").alias("place"),
        F.lit(0).cast("bigint").alias("n_usable"),
        F.lit(0).cast("bigint").alias("n_failed"),
    )
    snapshots.merge(asked, f"{store}/results", KEYS, _one_row_per_request, buckets=BUCKETS)


def ingest_results(lines: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived, merge it into ``store``, stop."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        parsed = parse_results(batch.withColumn("line", F.monotonically_increasing_id()))
        folder = f"{store}/arrivals/batch_id={batch_id}"
        observed(parsed, seen).write.mode("overwrite").parquet(folder)
        folders.write_text(spark, f"{store}/counts/{batch_id}.json", json.dumps(seen.get))
        arrived = spark.read.schema(ARRIVALS).parquet(folder).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        snapshots.merge(
            _arrived(arrived), f"{store}/results", KEYS, _one_row_per_request, batch=batch_id, buckets=BUCKETS
        )

    return (
        lines.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """One row per job and custom id; none before the first arrival or request.

    ``state`` is complete, pending (asked for, nothing usable yet), orphan (a result
    nobody asked for) or failed (nobody asked and nothing usable);
    ``n_duplicates`` are the usable lines after the first.
    """
    rows = snapshots.read_snapshot(spark, f"{store}/results", REQUESTS)
    usable = F.col("n_usable") > 0
    state = (
        F.when(usable & F.col("asked"), "complete")
        .when(usable, "orphan")
        .when(F.col("asked"), "pending")
        .otherwise("failed")
    )
    return rows.select(
        *KEYS,
        state.alias("state"),
        "content",
        F.greatest(F.col("n_usable") - 1, F.lit(0)).alias("n_duplicates"),
        "n_failed",
    )


def ingest_errors(spark: SparkSession, store: str) -> DataFrame:
    """Lines that gave no content: ``(batch_id, file, block, line, job, custom_id, error, line_text)``."""
    if not folders.names(spark, f"{store}/arrivals"):
        return result_errors(spark.createDataFrame([], ARRIVALS), [*PLACE, "job"])
    return result_errors(spark.read.schema(ARRIVALS).parquet(f"{store}/arrivals"), [*PLACE, "job"])


def ingest_counts(spark: SparkSession, store: str) -> DataFrame:
    """``(batch_id, lines, usable, broken, no_id, no_content)`` of every micro-batch."""
    schema = "batch_id bigint, lines bigint, usable bigint, broken bigint, no_id bigint, no_content bigint"
    names = folders.names(spark, f"{store}/counts")
    if not names:
        return spark.createDataFrame([], schema)
    counts = spark.read.schema(schema).json(f"{store}/counts")
    number = F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("bigint")
    return counts.withColumn("batch_id", number)
