"""What several operators of this part share: written tables, prefix sums, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.session import scratch_table

BLOCK = 1024


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, lineage cut,
    safe from lost executors."""
    return scratch_table(df, "llm")


def block_pairs(
    members: DataFrame, visitors: DataFrame, columns: list[str], blocks: int, visitor_blocks: int
) -> DataFrame:
    """Every block of members with every block of visitors: ``meet``, the columns, ``visits``.

    Rows are dealt to blocks by a hash of their columns, evenly if they differ.
    A group of one ``meet`` is one block of each.
    """

    def dealt(part: DataFrame, own: int, other: int, name: str, against: str, visits: bool) -> DataFrame:
        place = F.pmod(F.xxhash64(*columns), F.lit(own)).alias(name)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias(against)
        return part.select(*columns, F.lit(visits).alias("visits"), place, every).select(
            F.xxhash64("block", "visitor_block").alias("meet"), *columns, "visits"
        )

    return dealt(members, blocks, visitor_blocks, "block", "visitor_block", False).union(
        dealt(visitors, visitor_blocks, blocks, "visitor_block", "block", True)
    )


def in_groups(
    dealt: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str, tasks: int | None = None
) -> DataFrame:
    """Apply ``work`` to the rows of each ``meet``, the first column, in turn.

    A partition is read once, in the order of ``meet``; one group is in memory at a time.
    Groups go to ``tasks`` tasks, else to as many as their bytes ask for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            meets = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(meets)) + 1).tolist(), len(meets)]
            for start, end in zip(edges, edges[1:]):
                if end > start:
                    if held and held[-1].column(0)[0].as_py() != meets[start]:
                        yield work(pa.Table.from_batches(held).combine_chunks())
                        held = []
                    held.append(batch.slice(start, end - start))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    by = [tasks] if tasks else []
    return dealt.repartition(*by, F.col("meet")).sortWithinPartitions("meet").mapInArrow(run, schema)


def prefix_sums(df: DataFrame, at: str, n: str) -> DataFrame:
    """``df(at, n)`` with unique non-negative ``at`` → ``at`` and ``before``, the sum of ``n``
    over all smaller ``at``.

    Sums run inside blocks of 1024, shifted by the sums of earlier blocks, so
    that one task sees a 1024th of the rows.
    """
    block = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    totals = block.groupBy("_block").agg(F.sum(n).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        block.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(shift, "_block")
        .select(at, (F.col("_in") + F.col("_shift")).alias("before"))
    )


def ranked(df: DataFrame, groups: list[str], salt: Column, rank: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without bringing a group together.

    ``salt`` (a small non-negative long) parts each group; rows are numbered
    per part and shifted by the counts of the parts before.  ``df`` must be a
    written table, or else deterministic.  Rows of a part are numbered in the
    order of all their columns, so rows that tie are interchangeable.
    """
    keys = [*groups, "_salt"]
    parted = df.withColumn("_salt", salt)
    counts = parted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    order = [c for c, kind in df.dtypes if not kind.startswith("map")]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        parted.withColumn("_no", number)
        .join(shifts, keys)
        .withColumn(rank, F.col("_no") + F.col("_shift"))
        .drop("_salt", "_no", "_shift")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``node`` and ``root``, the smallest node
    reachable.  Nodes without an edge to another node do not appear.

    Alternating large and small stars until nothing changes.  A node's
    neighbours are only reduced to their smallest (map-side) and joined, which
    AQE splits for a node with very many; each round is a written table.
    """
    links = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        mark = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h"),
        ).first()
        if seen == tuple(mark):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
        both = links.union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = written(small)


def forest(a: list, b: list) -> list[tuple]:
    """A spanning forest of a few links (a, b), inside a task."""
    top: dict = {}

    def root(x):
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    kept = []
    for x, y in zip(a, b):
        if (rx := root(x)) != (ry := root(y)):
            top[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept
