"""A table with one row per key that batches are merged into, one whole version after the other.

::

    <store>/data/<id>/bucket=<n>/…   rows, written once and never changed
    <store>/versions/<version>.json  which folder holds each bucket

A merge rewrites the buckets that its rows touch into a new folder and then
publishes a manifest by one rename.  Until that rename every reader sees the
version before, and a merge that dies leaves files that nothing refers to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusweave.sources import folders

# Buckets of keys: what a merge rewrites at least.  Fixed by the first merge.
BUCKETS = 64


def manifest(spark: SparkSession, store: str) -> dict | None:
    """The newest manifest; None before the first merge."""
    found = [n for n in folders.names(spark, f"{store}/versions") if n.endswith(".json")]
    return json.loads(folders.read_text(spark, f"{store}/versions/{found[-1]}")) if found else None


def _rows(spark: SparkSession, store: str, held: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(held["schema"])
    paths = [f"{store}/data/{held['buckets'][b]}/bucket={b}" for b in buckets if b in held["buckets"]]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_snapshot(spark: SparkSession, store: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of the newest version; an empty table of ``schema`` before the first merge."""
    held = manifest(spark, store)
    if held is None:
        if schema is None:
            raise FileNotFoundError(f"nothing has been merged into {store}")
        return spark.createDataFrame([], schema)
    return _rows(spark, store, held, sorted(held["buckets"]))


def merge(
    rows: DataFrame,
    store: str,
    keys: list[str],
    reduce: Callable[[DataFrame], DataFrame],
    batch: int | None = None,
    buckets: int = BUCKETS,
    instead: DataFrame | None = None,
) -> bool:
    """Merge ``rows`` into the store as its next version; False if ``batch`` is merged already.

    ``reduce`` makes one row per key of rows of the store and new ones together,
    and keeps their columns.  Only buckets with new rows are read and rewritten.
    Batches with a number are merged in ascending order: the number is published
    with the version, so a batch that is replayed changes nothing.  Rows of the
    store with a key of ``instead(keys…)`` are forgotten first.
    """
    spark = rows.sparkSession
    held = manifest(spark, store) or {"version": 0, "batch": None, "buckets": {}, "n": buckets}
    if batch is not None and held["batch"] is not None and batch <= held["batch"]:
        return False
    bucket = F.pmod(F.xxhash64(*keys), F.lit(held["n"])).cast("int").alias("bucket")
    changed = rows.select(*keys)
    if instead is not None:
        changed = changed.unionByName(instead.select(*keys))
    touched = [str(r.bucket) for r in changed.select(bucket).distinct().collect()]
    every = rows
    if held["version"]:
        before = _rows(spark, store, held, touched)
        if instead is not None:
            before = before.join(instead.select(*keys), keys, "left_anti").select(before.columns)
        every = before.unionByName(rows.select(before.columns))
    folder = uuid.uuid4().hex
    merged = reduce(every)
    # rebalancing gathers each bucket into few files and splits a large one
    placed = merged.select("*", bucket)
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{store}/data/{folder}")
    # a bucket whose rows are all forgotten has no folder
    there = {n.removeprefix("bucket=") for n in folders.names(spark, f"{store}/data/{folder}")}
    kept = {b: at for b, at in held["buckets"].items() if b not in touched}
    version = held["version"] + 1
    text = json.dumps(
        {
            "version": version,
            "batch": batch if batch is not None else held["batch"],
            "n": held["n"],
            "schema": json.loads(merged.schema.json()),
            "buckets": kept | {b: folder for b in touched if b in there},
        }
    )
    draft = f"{store}/versions/.draft-{folder}"
    folders.write_text(spark, draft, text)
    # of two merges at a time the later one fails here
    folders.rename_new(spark, draft, f"{store}/versions/{version:012d}.json")
    return True
