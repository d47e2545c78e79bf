"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import components, forest, in_groups, written
from corpusweave.llm.neighbours import _by_width, _matrix, grouped, usable

COSINE = 0.95
BLOCK = 16
SEED = 3
# Members that a cell should have, and twice as many rows make a piece of it; of whole vectors
# an eighth makes one.
CELL = 16384
MAX_BITS = 12
TILE = 512
# Rows of a chunk, coordinates as integers of 16 bits, and comparisons of a task.
CHUNK = 64
ONE = 32767
TASK_PAIRS = 1 << 30


@cache
def rotation(width: int) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


@cache
def blocks(width: int) -> list[tuple[int, int]]:
    """Consecutive blocks of about 16 of the rotated dimensions."""
    edges = np.linspace(0, width, max(1, round(width / BLOCK)) + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def rotated(part: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; the same bits for a vector in whatever batch it comes."""
    part = part / np.abs(part).max(axis=1, keepdims=True)
    part = part / np.sqrt((part * part).sum(axis=1, keepdims=True))
    return np.einsum("ij,jk->ik", part, rotation(part.shape[1]), optimize=False)


def budget(width: int, block: tuple[int, int], cosine: float) -> float:
    """A block's share of the squared distance 2 - 2 cos, by its dimensions."""
    return (2 - 2 * cosine) * (block[1] - block[0]) / width


def _cells(z: np.ndarray, bits: int) -> np.ndarray:
    return ((z[:, :bits] > 0) << np.arange(bits)).sum(axis=1)


def reach(z: np.ndarray, bits: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all sign cells that a row can reach for half of a block's budget.

    If signs of two vectors differ in some dimensions, their distance there is
    at least the sum of both distances to zero; so one of the two crosses for
    half the budget or less.
    """
    cells = np.arange(1 << bits)
    up = ((cells[:, None] >> np.arange(bits)) & 1).astype(bool)
    square = z[:, :bits] ** 2
    positive = np.where(z[:, :bits] > 0, square, 0)
    cost = positive @ (~up).T.astype(float) + (square - positive) @ up.T.astype(float)
    return np.nonzero(cost <= most / 2 * (1 + 1e-9))


def _spread(values: pa.RecordBatch | pa.Table, name: str, kind: str) -> np.ndarray:
    """The numbers in the binary cells of a column, one after the other."""
    return np.frombuffer(b"".join(values.column(name).to_pylist()), kind)


def _chunks(
    key: int, cells: np.ndarray, member: bool, ids: np.ndarray, places: np.ndarray
) -> pa.RecordBatch:
    """Rows of ascending cells as chunks of at most 64 rows of one cell: ids and places as bytes."""
    cuts = np.flatnonzero(np.diff(cells, prepend=-1))
    ends = np.append(cuts[1:], len(cells))
    at = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b, CHUNK) for a, b in zip(cuts, ends)]])
    edges = np.append(at, len(cells))

    def packed(values: np.ndarray, size: int) -> pa.Array:
        buffers = [None, pa.py_buffer((edges * size).astype(np.int32)), pa.py_buffer(values.tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(at), buffers)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(key + cells[at]),
            pa.array(np.full(len(at), member)),
            packed(ids, 8),
            packed(places, 2 * places.shape[1]),
        ],
        ["cell", "member", "ids", "places"],
    )


def near_rows(
    ids: np.ndarray, places: np.ndarray, asks: np.ndarray, asked: np.ndarray, limit: float
) -> tuple[np.ndarray, np.ndarray]:
    """Which visitors ``(ids, places)`` have a member ``(asks, asked)`` of another id within
    ``limit``, a squared distance, and which members a visitor; places as integers."""
    mine, other = places.astype(np.float32) / ONE, asked.astype(np.float32) / ONE
    slack = np.float32(limit + 1e-5) - (mine * mine).sum(axis=1)
    left = np.column_stack([2 * mine, -np.ones(len(mine), np.float32), slack])
    right = np.column_stack([other, (other * other).sum(axis=1), np.ones(len(other), np.float32)]).T
    visits, visited = np.zeros(len(ids), bool), np.zeros(len(asks), bool)
    width = max(1, (1 << 23) // max(1, len(asks)))
    for at in range(0, len(ids), width):
        found = np.flatnonzero(left[at : at + width] @ right >= 0)
        row, col = at + found // max(1, len(asks)), found % max(1, len(asks))
        apart = ids[row] != asks[col]
        visits[row[apart]] = visited[col[apart]] = True
    return visits, visited


def linked(
    ids: np.ndarray,
    x: np.ndarray,
    visitors: np.ndarray,
    members: np.ndarray,
    block: int,
    bits: int,
    cosine: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Places (visitor, member) of the links that this cell and block count, ``x`` as given."""
    z = rotated(x)
    width = z.shape[1]
    edges = blocks(width)
    lo, hi = edges[block]
    signs = min(bits, hi - lo)
    starts = [e[0] for e in edges]
    limits = np.array([budget(width, e, cosine) for e in edges]) * (1 + 1e-9)
    own = z[members, lo:hi]
    norms = (own * own).sum(axis=1)
    lengths = np.sqrt((x * x).sum(axis=1))
    left, right = [], []
    for at in range(0, len(visitors), TILE):
        rows = visitors[at : at + TILE]
        part = z[rows, lo:hi]
        rough = (part * part).sum(axis=1)[:, None] + norms - 2 * part @ own.T
        row, col = np.nonzero(rough <= limits[block] + 1e-9)
        for k in range(0, len(row), 50_000):
            a, b = rows[row[k : k + 50_000]], members[col[k : k + 50_000]]
            near = np.add.reduceat((z[a] - z[b]) ** 2, starts, axis=1) <= limits
            first = near[:, block] & ~near[:, :block].any(axis=1) & (ids[a] != ids[b])
            a, b = a[first], b[first]
            u, v = z[a, lo : lo + signs], z[b, lo : lo + signs]
            apart = (u > 0) != (v > 0)
            mine, other = (u * u * apart).sum(axis=1), (v * v * apart).sum(axis=1)
            here = (mine < other) | ((mine == other) & (ids[a] < ids[b]))
            a, b = a[here], b[here]
            # the vectors themselves decide
            close = (x[a] * x[b]).sum(axis=1) / (lengths[a] * lengths[b]) >= cosine
            left.append(a[close])
            right.append(b[close])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _dealt(rows: DataFrame, counts: DataFrame, size: int, salt: Column, columns: list[str]) -> DataFrame:
    """Every piece of the members of a cell with every piece of its visitors: ``meet`` and the columns.

    ``counts(cell, members, visitors)``; pieces have about ``size`` rows, dealt by ``salt``.  Only cells of
    several pieces, or without a member, are looked up.
    """
    pieces = counts.select(
        "cell",
        F.ceil(F.col("members") / size).cast("long").alias("_members"),
        F.ceil(F.col("visitors") / size).cast("long").alias("_visitors"),
    ).where("_members <> 1 or _visitors <> 1")
    one = F.lit(1).cast("long")
    told = rows.join(F.broadcast(pieces), "cell", "left").withColumns(
        {n: F.coalesce(n, one) for n in ("_members", "_visitors")}
    )
    every = lambda n: F.sequence(one, F.col(n))
    here = lambda n: F.pmod(F.xxhash64(salt, F.lit(n)), F.col(n)) + 1
    member = F.transform(every("_visitors"), lambda v: F.struct(here("_members").alias("m"), v.alias("v")))
    visitor = F.transform(every("_members"), lambda m: F.struct(m.alias("m"), here("_visitors").alias("v")))
    return (
        told.where("_members > 0 and _visitors > 0")
        .select(*columns, F.inline(F.when(F.col("member"), member).otherwise(visitor)))
        .select(F.xxhash64("cell", "m", "v").alias("meet"), *columns)
    )


def vector_links(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Link vectors whose cosine, in double precision, is ``cosine`` or more.

    Unit vectors are rotated at random and split into blocks of 16 dimensions.
    A pair within squared distance 2 - 2 cos lies, in at least one block, within
    the block's share of it.  In each block space is cut by the signs of some
    dimensions, more the more vectors there are; a vector is a member of its
    own cell and visits the cells that it reaches within half of the budget.
    Cells of many members or visitors go in pieces, and a task holds one piece
    of both.

    Rows first meet with their coordinates in the block alone, as integers of 16
    bits: what has another row within the budget there, rounding allowed for, is
    written, ids only.  Only these rows meet once more in their cells, with whole
    vectors: visitors are compared with members in the block, what is within the
    budget is verified by the cosine of the vectors as given, and a pair is
    counted once: in its first block, on the side that crosses for less.
    This passes on counts and a spanning forest, never pairs.  Equal vectors are
    one from the start.

    Returns a row per input row: ``vec_id, n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable), ``kept``.  Vectors that
    are null, empty, zero or not finite link with nothing (0, their own id);
    vectors of different lengths neither.  A null id is not the smallest id
    unless there is no other.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    good = usable(F.col("vector"))
    rows = rows.withColumn("node", F.when(good, F.xxhash64("vector")))
    nodes = rows.where("node is not null").groupBy("node", "vector")
    nodes = written(nodes.agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")))
    bits = max(0, min(MAX_BITS, int(np.ceil(np.log2(max(nodes.count(), 1) / CELL)))))

    def visit(batches: Iterator[pa.RecordBatch], count: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for width, at in _by_width(batch, 1):
                z = rotated(_matrix(batch.column(1).take(pa.array(at))))
                for b, (lo, hi) in enumerate(blocks(width)):
                    part = z[:, lo:hi]
                    signs = min(bits, hi - lo)
                    row, cell = reach(part, signs, budget(width, (lo, hi), cosine))
                    own = _cells(part, signs)
                    key = (width << 32) + (b << 16)
                    if count:
                        some = np.unique(cell)
                        members = np.bincount(own, minlength=1 << signs)[some]
                        visitors = np.bincount(cell, minlength=1 << signs)[some]
                        columns = [pa.array(c.astype(np.int64)) for c in (key + some, members, visitors)]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "members", "visitors"])
                        continue
                    places = np.rint(part * ONE).astype(np.int16)
                    for member, rows, cells in ((True, np.arange(len(own)), own), (False, row, cell)):
                        order = np.argsort(cells, kind="stable")
                        rows = rows[order]
                        yield _chunks(key, cells[order], member, ids[at[rows]], places[rows])

    pairs = nodes.select(F.col("node").alias("id"), "vector")
    counts = pairs.mapInArrow(partial(visit, count=True), "cell long, members long, visitors long")
    counts = written(counts.groupBy("cell").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors")))
    n_pairs = counts.agg(F.sum(F.col("members").cast("double") * F.col("visitors"))).first()[0] or 0
    sent = pairs.mapInArrow(partial(visit, count=False), "cell long, member boolean, ids binary, places binary")
    met = _dealt(sent, counts, 2 * CELL, F.xxhash64("ids"), ["cell", "member", "ids", "places"])

    def sift(rows: pa.Table) -> pa.RecordBatch:
        cell = rows.column("cell")[0].as_py()
        lo, hi = blocks(cell >> 32)[(cell >> 16) & 0xFFFF]
        # coordinates are off by half a unit at most, in both rows
        limit = (np.sqrt(budget(cell >> 32, (lo, hi), cosine)) + np.sqrt(hi - lo) / ONE) ** 2
        sides = [rows.filter(rows.column("member")), rows.filter(pa.compute.invert(rows.column("member")))]
        (asks, asked), (ids, places) = [
            (_spread(side, "ids", np.int64), _spread(side, "places", np.int16).reshape(-1, hi - lo)) for side in sides
        ]
        visits, visited = near_rows(ids, places, asks, asked, limit)
        some = np.concatenate((asks[visited], ids[visits]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(some), cell)),
                pa.array(np.arange(len(some)) < visited.sum()),
                pa.array(some),
            ],
            ["cell", "member", "id"],
        )

    # as many tasks as there is to compare, which the bytes do not tell
    tasks = max(1, min(int(n_pairs // TASK_PAIRS) + 1, 1 << 16))
    near = written(in_groups(met, sift, "cell long, member boolean, id long", tasks).distinct())
    counts = near.groupBy("cell").agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("visitors"))
    whole = near.join(nodes.select(F.col("node").alias("id"), "vector", "copies"), "id")
    dealt = _dealt(whole, counts, max(1, CELL // 8), F.xxhash64("id"), ["id", "vector", "cell", "member", "copies"])

    def compare(ids: np.ndarray, part: np.ndarray, more: list[np.ndarray]) -> pa.RecordBatch:
        cell, member, copies = more
        block = (int(cell[0]) >> 16) & 0xFFFF
        a, b = linked(ids, part, np.flatnonzero(~member), np.flatnonzero(member), block, bits, cosine)
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, a, copies[b])
        np.add.at(counts, b, copies[a])
        some = np.flatnonzero(counts)
        tree = np.array(forest(ids[a].tolist(), ids[b].tolist()), np.int64).reshape(-1, 2)
        none = [None] * len(some)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((ids[some], tree[:, 0]))),
                pa.array(none + tree[:, 1].tolist(), pa.int64()),
                pa.array(counts[some].tolist() + [None] * len(tree), pa.int64()),
            ],
            ["a", "b", "links"],
        )

    found = written(grouped(dealt, compare, "a long, b long, links long"))
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "copies", "least").join(roots, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    alone = F.col("node").isNull()
    return (
        rows.select("vec_id", "node")
        .join(named, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
