"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search.

A signature has 48 symbols of 14 bits in 12 chunks of 4.  If two signatures
differ in at most 23 symbols, some chunk differs in at most one (pigeonhole),
so both have equal keys for that chunk with that symbol left out: 48 keys a
signature find every pair within distance 23.  At the similarity 0.8 a symbol
differs with probability 0.2; more than 23 of 48 differ once in 400,000 pairs
right at the threshold, and far more rarely above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import hashing
from corpusweave.llm.common import components, forest, ranked, written

WIDTH = 4
PERCENT = 80
CHUNKS = 12
PER_CHUNK = 4
BITS = 14
DISTANCE = 2 * CHUNKS - 1
SEED = 11
FAMILY_BLOCK = 128
SALTS = 16

LANE = BITS + 1
_FILL = sum(((1 << BITS) - 1) << (LANE * j) for j in range(PER_CHUNK))
_FLAG = sum(1 << (LANE * j + BITS) for j in range(PER_CHUNK))
SIGNATURE = [f"s{c}" for c in range(CHUNKS)]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chunks of a set's signature: 4 symbols to a long, 15 bits apart."""
    least = np.empty(len(a), np.uint64)
    for k in range(0, len(a), 8):
        part = slice(k, k + 8)
        least[part] = (found * a[part, None] + b[part, None]).min(axis=1)
    symbols = (hashing.mix(least) >> np.uint64(64 - BITS)).astype(np.int64).reshape(CHUNKS, PER_CHUNK)
    return (symbols << (LANE * np.arange(PER_CHUNK))).sum(axis=1)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 63, (2, CHUNKS * PER_CHUNK), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def _digest(found: np.ndarray) -> int:
    """64 bits that tell shingle sets apart; their order does not matter."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(hashing.mix(found ^ np.uint64(hashing.BASE)))
    return int(hashing.mix(np.array([total + np.uint64(len(found))]))[0].astype(np.int64))


def row_digest(key: str, text: str) -> Column:
    """64 bits of a row's id and text."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``doc_id, row`` (digest of id and text), ``n_shingles, node`` (digest of the set, null if
    it is empty) and the signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions()
        for batch in batches:
            sizes, nodes, chunks = [], [], []
            for value in batch.column(2):
                found = hashing.shingles(hashing.word_hashes(value.as_py()), width)
                sizes.append(len(found))
                nodes.append(_digest(found) if len(found) else None)
                chunks.append(signature(found, a, b) if len(found) else np.zeros(CHUNKS, np.int64))
            columns = np.array(chunks, np.int64).reshape(-1, CHUNKS).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())]
                + [pa.array(c) for c in columns],
                ["doc_id", "row", "n_shingles", "node", *SIGNATURE],
            )

    names = ["doc_id", "row", "n_shingles", "node", *SIGNATURE]
    rows = docs.select(F.col(key).cast("long"), row_digest(key, text), F.col(text))
    return rows.mapInArrow(sign, ", ".join(f"{n} long" for n in names))


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``node`` and ``found``, the whole shingle set, of every text that has one; sets that
    repeat within a task come once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = {}
            for value in batch.column(0):
                found = hashing.shingles(hashing.word_hashes(value.as_py()), width)
                if len(found) and (node := _digest(found)) not in seen:
                    fresh[node] = found.view(np.int64)
            seen.update(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(fresh), pa.int64()),
                    pa.array(list(fresh.values()), pa.list_(pa.int64())),
                ],
                ["node", "found"],
            )

    return docs.select(F.col(text)).mapInArrow(sets, "node long, found array<long>")


def _keys() -> Column:
    """The 48 keys of a signature: each chunk with each symbol left out."""
    keys = []
    for c in range(CHUNKS):
        for j in range(PER_CHUNK):
            rest = _FILL & ~(((1 << BITS) - 1) << (LANE * j))
            masked = F.col(SIGNATURE[c]).bitwiseAND(F.lit(rest))
            keys.append(F.xxhash64(F.lit(c * PER_CHUNK + j), masked))
    return F.array(*keys)


def _distance(left: str, right: str) -> Column:
    """Symbols in which two signatures differ: lanes of the XOR that are not zero."""
    total = F.lit(0)
    for s in SIGNATURE:
        differ = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        total = total + F.bit_count((differ + F.lit(_FILL)).bitwiseAND(F.lit(_FLAG)))
    return total


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` within the signature distance."""
    mine = classes.select(F.col("node").alias("a"), F.struct(*SIGNATURE).alias("x"))
    other = classes.select(F.col("node").alias("b"), F.struct(*SIGNATURE).alias("y"))
    near = pairs.join(mine, "a").join(other, "b")
    return near.where(_distance("x", "y") <= DISTANCE).select("a", "b")


def ringed(members: DataFrame, percent: int) -> DataFrame:
    """``family, node, leader, ring``: how far each member's whole set is from its leader's.

    The leader is the smallest node of a family.  Ring 0 is linked to it; ring k
    is at a distance over k and up to k + 1 times the distance of a link.
    """
    leaders = members.groupBy("family").agg(F.min("node").alias("node"))
    sets = members.join(leaders, ["family", "node"]).select(
        "family", F.col("node").alias("leader"), F.col("found").alias("led")
    )
    common = F.size(F.array_intersect("found", "led")).cast("long")
    judged = members.join(sets, "family").select(
        "family", "node", "leader", common.alias("c"), (F.size("found") + F.size("led")).cast("long").alias("n")
    )
    # the smallest k for which 100 * (union - common) <= (k + 1) * (100 - percent) * union
    step = F.expr("n - c") * F.lit(max(100 - percent, 1))
    rings = F.ceil(F.expr("100 * (n - 2 * c)") / step).cast("int")
    return judged.select("family", "node", "leader", F.greatest(rings - 1, F.lit(0)).alias("ring"))


def block_meetings(rings: DataFrame) -> DataFrame:
    """``meet, node``: which blocks of members are to be compared.

    Distances of sets are a metric, so two members whose distances to the leader
    differ by more than a link's can't be linked: members meet those of their
    own ring and of the next.  Ring 0 is connected already and does not meet
    itself, so copies are made for members outside of it only.
    """
    numbered = ranked(
        rings.select("family", "ring", "node"), ["family", "ring"], F.pmod(F.xxhash64("node"), F.lit(SALTS)), "rank"
    ).select("family", "ring", "node", F.floor(F.col("rank") / FAMILY_BLOCK).alias("block"))
    blocks = numbered.groupBy("family", "ring").agg((F.max("block") + 1).alias("blocks"))
    side = lambda shift, name: blocks.select(
        "family", (F.col("ring") + shift).alias("ring"), F.col("blocks").alias(name)
    )
    counted = (
        numbered.join(blocks, ["family", "ring"])
        .join(side(-1, "outer"), ["family", "ring"], "left")
        .join(side(1, "inner"), ["family", "ring"], "left")
    )

    def others(n: Column, ring: Column, swap: bool) -> Column:
        """Meetings with every block of a ring: (lower ring, its block, the other block)."""
        every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
        mine = F.col("block")
        return F.transform(
            every,
            lambda o: F.struct(
                ring.alias("ring"),
                (o if swap else mine).cast("long").alias("one"),
                (mine if swap else o).cast("long").alias("two"),
                F.lit(True).alias("across"),
            ),
        )

    own = F.transform(
        F.when(F.col("ring") > 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(
            F.array().cast("array<long>")
        ),
        lambda o: F.struct(
            F.col("ring").alias("ring"),
            F.least(o, F.col("block")).cast("long").alias("one"),
            F.greatest(o, F.col("block")).cast("long").alias("two"),
            F.lit(False).alias("across"),
        ),
    )
    ring, zero = F.col("ring"), F.lit(0).cast("long")
    meetings = F.concat(
        own,
        others(F.coalesce("outer", zero), ring, swap=False),
        others(F.coalesce("inner", zero), ring - 1, swap=True),
    )
    return counted.select("family", "node", F.explode(meetings).alias("m")).select(
        F.xxhash64("family", "m.ring", "m.one", "m.two", "m.across").alias("meet"), "node"
    )


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` inside families: enough of them to connect what is linked.

    ``members(family, node, found)``.  Every member's whole set is compared with
    its leader's first.  What is linked to the leader is one already; the rest
    meets, in blocks of 128, what the leader's distance leaves possible
    (:func:`block_meetings`).  A task compares whole sets by products of 0/1
    matrices over the shingles that several of them share, and passes on only
    links that join what it has not joined yet: at most one for each member,
    never all pairs.  At worst, when few members are linked to their leader,
    a family of n members is copied n/128 times.
    """
    rings = written(ringed(members, percent))
    # nodes are different sets, so at 100 percent none are linked
    stars = rings.where((F.col("ring") == 0) & (F.col("node") != F.col("leader")) & F.lit(percent < 100))
    stars = stars.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    dealt = block_meetings(rings).join(members.select("node", "found"), "node").select("meet", "node", "found")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet, nodes, sets = None, [], []

        def linked() -> pa.RecordBatch:
            pairs = _spanning(nodes, sets, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            for at, node, found in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ):
                if at != meet:
                    if len(nodes) > 1:
                        yield linked()
                    meet, nodes, sets = at, [], []
                nodes.append(node)
                sets.append(found.values.to_numpy())
        if len(nodes) > 1:
            yield linked()

    parts = dealt.repartition(F.col("meet")).sortWithinPartitions("meet")
    return stars.union(parts.mapInArrow(compare, "a long, b long"))


def _spanning(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few sets."""
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    common = np.zeros((len(sets), len(sets)), np.float32)
    row, column = row[keep], place[column[keep]]
    for at in range(0, int(often.sum()), 4096):
        there = (column >= at) & (column < at + 4096)
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[there], column[there] - at] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    left, right = np.nonzero(np.triu(100 * common >= percent * union, 1))
    return [(nodes[x], nodes[y]) for x, y in forest(left.tolist(), right.tolist())]


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """Link documents whose sets of ``width``-word shingles are similar by ``percent`` or more.

    Documents with equal sets are one node from the start.  In each bucket of
    an equal key every node meets the smallest and the largest node there (two
    stars, not all pairs), and pairs within the signature distance make
    families.  Where a bucket still holds several families, their nodes meet
    each other too, so any two nodes within the distance are in one family.
    Inside a family whole sets are compared (``family_links``), and confirmed
    links make the components.

    Returns one row per document: ``doc_id, row`` (digest of id and text),
    ``n_shingles, node, root`` (digests of the set and of its component),
    ``component_id`` (smallest id reachable) and ``kept`` (it is that id).  Null or blank texts
    have no shingles (node null) and stand alone; a null id is a component's
    id only if all of its ids are null; rows that repeat an id and a text are
    kept or not together.  Other columns are not read.
    """
    light = written(signed(docs, key, text, width))
    nodes = light.where("node is not null").groupBy("node")
    classes = written(
        nodes.agg(F.min("doc_id").alias("least"), *[F.first(s).alias(s) for s in SIGNATURE])
    )
    keyed = classes.select("node", F.explode(_keys()).alias("key"))
    buckets = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")
    )
    shared = written(keyed.join(buckets.where("n > 1"), "key").select("key", "node", "lo", "hi"))
    stars = shared.select("node", F.explode(F.array("lo", "hi")).alias("lead")).where("node <> lead")
    stars = written(_close(stars.select(*_ordered("node", "lead")).distinct(), classes))
    found = components(stars)

    # buckets in which several families meet: their nodes against each other
    rooted = shared.select("key", "node").join(found, "node", "left")
    rooted = written(rooted.select("key", "node", F.coalesce("root", "node").alias("root")))
    ends = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = rooted.join(ends.where("lo < hi").select("key"), "key").join(classes.drop("least"), "node")
    mixed = written(mixed.select("key", "root", "node", F.struct(*SIGNATURE).alias("s")))
    x, y = mixed.alias("x"), mixed.alias("y")
    across = x.join(
        y, F.expr("x.key = y.key and x.root < y.root") & (_distance("x.s", "y.s") <= DISTANCE)
    )
    across = across.select(*_ordered("x.node", "y.node"))
    families = written(components(stars.union(across)))
    families = families.union(families.select("root", "root").distinct())
    families = families.toDF("node", "family")

    # the whole set of each node in a family, from one text
    wanted = families.join(classes.select("node", "least"), "node").select("least").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("least"))).select("text")
    sets = shingle_sets(texts, "text", width)
    members = written(families.join(sets, "node"))
    found = components(family_links(members, percent))

    named = classes.select("node", "least").join(found, "node", "left")
    named = named.select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("node", "root", "component_id")
    alone = F.col("node").isNull()
    return (
        light.select("doc_id", "row", "n_shingles", "node")
        .join(named, "node", "left")
        .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "row", "n_shingles", "node", "root", "component_id", "kept")
    )
