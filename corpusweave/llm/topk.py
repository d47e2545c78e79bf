"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import block_pairs, in_groups, written

K = 5
SCALE = 256
# rows of a candidate block (one dense score array) and of a query block
BLOCK = 4096
QUERIES = 1024
END = -(1 << 63), (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return F.coalesce(good, F.lit(False))


class Rows:
    """Sparse integer rows of an Arrow list column: terms (positions) and weights other than 0."""

    def __init__(self, weights: pa.ListArray):
        lengths = np.diff(weights.offsets.to_numpy())
        values = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        some = np.flatnonzero(values)
        self.owner, self.term, self.weight = owner[some], term[some], values[some]
        self.starts = np.searchsorted(self.owner, np.arange(len(lengths) + 1))
        self.n = len(lengths)
        self.most = int(np.abs(self.weight).max(initial=0))
        self.width = int(lengths.max(initial=0))


def postings(rows: Rows, kind) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """Term → (places, weights).  A term that over half of the rows have is a full array
    instead, with zeros for the others and no places."""
    found = {}
    order = np.argsort(rows.term, kind="stable")
    terms, starts = np.unique(rows.term[order], return_index=True)
    for term, part in zip(terms.tolist(), np.split(order, starts[1:])):
        places, weights = rows.owner[part], rows.weight[part].astype(kind)
        if 2 * len(places) > rows.n:
            full = np.zeros(rows.n, kind)
            full[places] = weights
            places, weights = None, full
        found[term] = places, weights
    return found


def scatter(terms: np.ndarray, weights: np.ndarray, posted: dict, scores: np.ndarray, spare: np.ndarray) -> None:
    """Add the weighted postings of a query's terms, one term after the other, into ``scores``."""
    scores[:] = 0
    for term, weight in zip(terms.tolist(), weights):
        if term in posted:
            places, held = posted[term]
            if places is None:
                np.multiply(held, weight, out=spare)
                scores += spare
            else:
                scores[places] += weight * held


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` ascend."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        ties = np.flatnonzero(scores == edge)[: k - len(above)]
        return np.concatenate((above, ties))
    return np.arange(len(ids))


def block_scores(ids: np.ndarray, weights: pa.ListArray, asks: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best candidates of one block for each query of one block."""
    queries, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    others = others[np.argsort(ids[others], kind="stable")]
    names, starts = np.unique(ids[others], return_index=True)
    rows, asking = Rows(weights.take(pa.array(others))), Rows(weights.take(pa.array(queries)))
    bound = rows.most * asking.most * max(rows.width, 1)
    # the smallest kind that holds every partial sum; beyond long, Python's own integers
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    posted = postings(rows, kind)
    scores, spare = np.zeros(rows.n, kind), np.zeros(rows.n, kind)
    asked_weights = asking.weight.astype(kind)
    out: list[list] = [[], [], []]
    for at, q in enumerate(queries.tolist()):
        part = slice(asking.starts[at], asking.starts[at + 1])
        scatter(asking.term[part], asked_weights[part], posted, scores, spare)
        held = scores if kind is not object else np.clip(scores, *END).astype(np.int64)
        held = held if len(names) == rows.n else np.maximum.reduceat(held, starts)
        own = np.searchsorted(names, ids[q])
        if own < len(names) and names[own] == ids[q]:
            held, ids_left = np.delete(held, own), np.delete(names, own)
        else:
            ids_left = names
        first = best(held, ids_left, k)
        out[0].append(np.full(len(first), ids[q]))
        out[1].append(ids_left[first])
        out[2].append(held[first])
    columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in out]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """The ``k`` rows of the highest inner product, for rows where ``is_query``; exact.

    Each component x becomes the integer floor(scale * x), x as double; a
    component other than 0 is a term of its row, its place in the vector names
    it.  Candidates are dealt evenly into blocks of about 4096 rows, queries
    into blocks of about 1024, and each pair of blocks meets in a group.  There
    the candidates become postings by term, and each query scatters its weighted
    postings, term after term, into one dense score array; a partition selection
    takes the k best of the block and the blocks' winners are merged.  Work is
    queries x candidates, as an exhaustive search has it; memory is two blocks.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``, ties to the smaller
    id; fewer rows if there are fewer others.  Rows whose vector is null or
    holds null or non-finite components, or whose id is null, take no part; an
    empty or zero vector scores 0 with all others, and a shorter vector has no
    terms beyond its length.  Rows that repeat an id count as one, at the
    highest score of any of them, and are no candidates of their own id.
    Integers and scores beyond the range of a long count as its end.  Other
    columns are not looked at, whatever their names.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    rows = rows.where(finite(F.col("vector")) & F.col("id").isNotNull())
    weight = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select("id", weight.alias("weights"), F.coalesce("asks", F.lit(False)).alias("asks"))
    # equal rows are one, so that blocks dealt by a hash are even
    rows = written(rows.groupBy("id", "weights").agg(F.max("asks").alias("asks")))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    blocks = max(1, -(-counts.rows // BLOCK))
    query_blocks = max(1, -(-counts.queries // QUERIES))

    both = block_pairs(rows, rows.where("asks"), ["id", "weights"], blocks, query_blocks)

    def compare(group: pa.Table) -> pa.RecordBatch:
        ids, asks = group.column("id").to_numpy(), group.column("visits").to_numpy()
        return block_scores(ids, group.column("weights").chunk(0), asks, k)

    found = in_groups(both, compare, "query_id long, vec_id long, score long")
    # an id may have rows in several blocks: its highest score counts
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
