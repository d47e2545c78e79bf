"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import block_pairs, in_groups, written

K = 10
TREES = 64
LEAF = 32
SEED = 5
# the trees are fitted on at most so many vectors; every vector is indexed
MAX_SAMPLE = 32_768
# leaves are searched until they hold this share of the rows of one tree, all trees together,
# rows that several leaves hold counted each time: about 0.6 of the rows are different
SEARCH_SHARE = 1.0
# rows of a block of vectors and of a block of queries
BLOCK = 4096
QUERIES = 512


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Forest:
    """Trees as arrays: inner nodes have a plane and two children, leaves have ~leaf number."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    shares: np.ndarray

    @staticmethod
    def grow(sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
        """Split by the plane between two random points, at the median, down to ``leaf`` points."""
        rng = np.random.default_rng(seed)
        normals, offsets, children, shares = [], [], [], []

        def build(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    at = sample[rows] @ (a - b)
                    cut = np.median(at)
                    low = at <= cut
                    if not low.all() and (norm := np.linalg.norm(a - b)) > 0:
                        me = len(normals)
                        normals.append((a - b) / norm)
                        offsets.append(cut / norm)
                        children.append([0, 0])
                        children[me] = [build(rows[low]), build(rows[~low])]
                        return me
            shares.append(len(rows) / len(sample))
            return ~(len(shares) - 1)

        roots = [build(np.arange(len(sample))) for _ in range(trees)]
        width = sample.shape[1]
        return Forest(
            np.array(normals, np.float32).reshape(-1, width),
            np.array(offsets, np.float32),
            np.array(children, np.int64).reshape(-1, 2),
            roots,
            np.array(shares),
        )

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        found = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(vectors)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    found[rows, t] = ~node
                elif len(rows):
                    low = vectors[rows] @ self.normals[node] <= self.offsets[node]
                    todo += [(self.children[node, 0], rows[low]), (self.children[node, 1], rows[~low])]
        return found

    def search(self, vector: np.ndarray, share: float) -> list[int]:
        """Leaves to look into: one queue for all trees, nearest first by the smallest margin
        on the way, until the leaves hold ``share`` of a tree's rows."""
        margins = self.normals @ vector - self.offsets
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, held = [], 0.0
        while queue and held < share:
            worst, node = heapq.heappop(queue)
            if node < 0:
                found.append(~node)
                held += self.shares[~node]
            else:
                m = margins[node]
                heapq.heappush(queue, (max(worst, m), int(self.children[node, 0])))
                heapq.heappush(queue, (max(worst, -m), int(self.children[node, 1])))
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch by the length of their vectors."""
    widths = pa.compute.list_value_length(batch.column(column)).to_numpy()
    for width in np.unique(widths):
        yield int(width), np.flatnonzero(widths == width)


def fit_forests(vectors: DataFrame, max_sample: int, trees: int, leaf: int) -> dict[int, Forest]:
    """A forest for each length of vectors, on at most ``max_sample`` of all vectors by a hash."""
    order = F.xxhash64("id", "vector")
    sample = vectors.orderBy(order, "id").limit(max_sample).select("vector").toArrow()
    rows = [np.array(v, np.float64) for v in sample.column("vector").to_pylist()]
    widths = {len(r) for r in rows}
    return {
        w: Forest.grow(np.array([r for r in rows if len(r) == w]), trees, leaf, SEED) for w in widths
    }


def _top(distances: np.ndarray, k: int) -> np.ndarray:
    """Columns that may be among the k smallest, ties and rounding included."""
    if len(distances) <= k:
        return np.arange(len(distances))
    edge = np.partition(distances, k - 1)[k - 1]
    return np.flatnonzero(distances <= edge + 1e-9 * (1 + abs(edge)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    share: float = SEARCH_SHARE,
    trees: int = TREES,
    leaf: int = LEAF,
    max_sample: int = MAX_SAMPLE,
) -> DataFrame:
    """The ``k`` nearest other rows by Euclidean distance, for rows where ``is_query``.

    Every row is in one leaf of each tree; a query looks into the leaves that
    its search through all trees asks for.  Vectors are dealt into blocks of
    about 4096 that carry their leaves, queries into blocks of about 512, and
    each pair of blocks meets in a task: there a query's candidates are the rows
    of its leaves, each once however many leaves hold it, and their distances
    are exact, in double precision.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``, ties to the smaller
    id; fewer rows if there are fewer others.  Vectors that are null, empty,
    zero or not finite take no part; vectors of different lengths never meet.
    Rows that repeat an id count as one if their vectors are equal too (else
    each has its distance, the smaller counts), and are no neighbours of
    their own id.  Other columns are not looked at, whatever their names.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")
    ).where(usable(F.col("vector")) & F.col("id").isNotNull())
    # equal rows are one, so that blocks dealt by a hash are even
    rows = written(rows.groupBy("id", "vector").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks")))
    forests = fit_forests(rows, max_sample, trees, leaf)
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    blocks = max(1, -(-counts.rows // BLOCK))
    query_blocks = max(1, -(-counts.queries // QUERIES))

    def placed(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at in _by_width(batch, 1):
                part = _matrix(batch.column(1).take(pa.array(at)))
                forest = forests.get(width)
                if forest is None:  # a length that the sample has missed: one leaf
                    leaves = [np.zeros(1, np.int32)] * len(at)
                elif asking:
                    leaves = [np.array(forest.search(v, share), np.int32) for v in part]
                else:
                    leaves = list(forest.leaves(part).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at)) for c in batch.columns], pa.array(leaves, pa.list_(pa.int32()))],
                    ["id", "vector", "leaves"],
                )

    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"id long, vector {kind}, leaves array<int>"
    members = rows.select("id", "vector").mapInArrow(partial(placed, asking=False), schema)
    asking = rows.where("asks").select("id", "vector").mapInArrow(partial(placed, asking=True), schema)
    both = block_pairs(members, asking, ["id", "vector", "leaves"], blocks, query_blocks)
    sizes = {w: len(f.shares) for w, f in forests.items()}

    def compare(group: pa.Table) -> pa.RecordBatch:
        ids, visits = group.column("id").to_numpy(), group.column("visits").to_numpy()
        held, leaves = group.column("vector").chunk(0), group.column("leaves").chunk(0)
        widths = pa.compute.list_value_length(held).to_numpy()
        found = []
        for width in np.unique(widths[visits]):
            queries, others = (np.flatnonzero((widths == width) & v) for v in (visits, ~visits))
            if len(others):
                # rows of one id side by side: they count as one, at their smallest distance
                others = others[np.argsort(ids[others], kind="stable")]
                part = _matrix(held.take(pa.array(others)))
                own = leaves.take(pa.array(others)).flatten().to_numpy().reshape(len(others), -1)
                looked = [leaves[int(q)].values.to_numpy() for q in queries]
                found += _nearest_in(
                    ids[queries], _matrix(held.take(pa.array(queries))), looked, ids[others], part, own, sizes.get(int(width), 1), k
                )
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)],
            ["query_id", "vec_id", "score"],
        )

    found = in_groups(both, compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _nearest_in(
    asking: np.ndarray,
    vectors: np.ndarray,
    looked: list[np.ndarray],
    ids: np.ndarray,
    part: np.ndarray,
    leaves: np.ndarray,
    n_leaves: int,
    k: int,
) -> list[tuple[np.ndarray, ...]]:
    """The k nearest different ids of a block among the candidates of each query."""
    norms = (part * part).sum(axis=1)
    found = []
    for name, vector, wanted in zip(asking, vectors, looked):
        searched = np.zeros(n_leaves, bool)
        searched[wanted] = True
        rows = np.flatnonzero(searched[leaves].any(axis=1) & (ids != name))
        if not len(rows):
            continue
        rough = norms[rows] - 2 * (part[rows] @ vector)
        starts = np.flatnonzero(np.diff(ids[rows], prepend=ids[rows[0]] - 1))
        least = np.minimum.reduceat(rough, starts)
        near = np.zeros(len(starts), bool)
        near[_top(least, k)] = True
        rows = rows[np.repeat(near, np.diff(np.append(starts, len(rows))))]
        exact = np.sqrt(((part[rows] - vector) ** 2).sum(axis=1))
        starts = np.flatnonzero(np.diff(ids[rows], prepend=ids[rows[0]] - 1))
        exact, names = np.minimum.reduceat(exact, starts), ids[rows[starts]]
        first = np.lexsort((names, exact))[:k]
        found.append((np.full(len(first), name), names[first], exact[first]))
    return found


def grouped(dealt: DataFrame, compare, schema: str) -> DataFrame:
    """Apply ``compare(ids, vectors, others)`` to the rows of each ``meet`` in turn.

    ``dealt(meet, id, vector, others …)``; a partition is read once, in the order
    of ``meet``, and one group is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            others = [table.column(i).to_numpy() for i in range(3, table.num_columns)]
            return compare(table.column(1).to_numpy(), _matrix(table.column(2).chunk(0)), others)

        for batch in batches:
            meets = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(meets)) + 1).tolist(), len(meets)]
            for start, end in zip(edges, edges[1:]):
                if end > start:
                    if held and held[-1].column(0)[0].as_py() != meets[start]:
                        yield whole()
                        held = []
                    held.append(batch.slice(start, end - start))
        if held:
            yield whole()

    return dealt.repartition(F.col("meet")).sortWithinPartitions("meet").mapInArrow(run, schema)
