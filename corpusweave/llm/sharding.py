"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import prefix_sums

SHARDS = 40
SEED = 20_240
BUCKET_BYTES = 64 << 20
# bounds the table of bucket starts that is broadcast: 16 bytes a row
MAX_BUCKETS = 1 << 20


def external_shuffle(
    records: DataFrame,
    size: Column,
    shards: int = SHARDS,
    place: list[Column] | None = None,
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """Put ``records`` in a random order and cut it into shards of equal row counts.

    First pass: a seeded hash scatters the records uniformly over buckets of
    about ``bucket_bytes`` (larger only beyond 2**20 buckets).  Second pass:
    each bucket, one task's memory, is put in the order of its hashes and
    Fisher-Yates shuffled with a seed of its own.  The buckets one after the
    other are the order; shard k holds ranks ceil(k*n/shards) on, so counts
    differ by one at most (law ``rows``).  Same rows and seed, same result.

    ``place``: columns that tell repeated rows apart, such as file and row
    number.  Without it, repeated rows are counted first and dealt out one by
    one, which costs a shuffle more and asks for columns that can be grouped.

    Returns ``record`` (a struct of all columns, whatever their names),
    ``size``, ``shard`` and ``slot`` (0, 1, … in each shard).  Null columns
    are values like others, a null size counts as 0; no records, no rows.
    """
    if place is None:
        copies = records.select(F.struct("*").alias("record"), size.alias("size"))
        copies = copies.groupBy("record", "size").count()
        copies = copies.select("record", "size", F.explode(F.sequence(F.lit(1), "count")).alias("no"))
        scatter = [F.col("record"), F.col("no")]
        rows = copies.select("record", "size", F.xxhash64(F.lit(seed), *scatter).alias("h"))
    else:
        rows = records.select(
            F.struct("*").alias("record"), size.alias("size"), F.xxhash64(F.lit(seed), *place).alias("h")
        )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n = max(total.n, 1)
    buckets = min(max(1, -(-(total.bytes or 0) // bucket_bytes)), MAX_BUCKETS)
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = F.broadcast(prefix_sums(counts, "bucket", "n"))
    entry = F.struct("h", "size", "record")
    dealt = (
        rows.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.shuffle(F.sort_array(F.collect_list(entry)), seed).alias("entries"))
        .join(starts, "bucket")
        .select("before", F.posexplode("entries").alias("at", "entry"))
        .select((F.col("before") + F.col("at")).alias("rank"), "entry.record", "entry.size")
    )
    shard = F.expr(f"rank * {shards} div {n}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (
        dealt.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select("record", "size", F.col("shard").cast("int"), F.col("slot").cast("long"))
    )


def write_shards(dealt: DataFrame, path: str) -> None:
    """Write each shard to a folder of its own; a bucket's ranks adjoin, so a task
    writes to few shards and needs no further shuffle."""
    dealt.write.partitionBy("shard").mode("overwrite").parquet(path)
