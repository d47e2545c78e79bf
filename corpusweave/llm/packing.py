"""Packing token sequences into windows by non-negative least squares over their histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.common import ranked, written

WINDOW = 4096
UNIT = 16
DEPTH = 3
END_ID = 2
# words whose ids a worker remembers; at the limit it starts afresh
MEMORY = 300_000
# bytes of text whose words are made unique together
TEXT_BYTES = 2 << 20
# words that go to the tokenizer at a time: what it returns is far larger than they are
LOOK_UP = 4096
PART_ROWS = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# --- tokens ------------------------------------------------------------------


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of a text as little-endian 32-bit bytes, put together from its words.

    For tokenizers that never join what white space parts, drop the white
    space itself, lower-case, and keep letters apart from punctuation: the ids
    of a text are then those of its words in a row, and a full stop or comma
    after a letter has ids of its own.  New words go to the tokenizer in one
    string, parted by its end-of-text token.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.known: dict[str, bytes] = {"": b""}

    def _look_up(self, words: list[str]) -> None:
        joined = self.mark.join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.mark_id)
        if self.mark_id is None or len(ends) != len(words) - 1:  # the mark stands in a word itself
            found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found))
            return
        whole, at = ids.tobytes(), 0
        for word, end in zip(words, [*ends.tolist(), len(ids)]):
            self.known[word] = whole[4 * at : 4 * end]
            at = end + 1

    def _ids(self, stems: list[str]) -> list[bytes]:
        known = self.known
        new = [w for w in stems if w not in known]
        if new:
            if len(known) > MEMORY:
                known.clear()
                known.update({"": b""})
                new = [w for w in stems if w]
            for k in range(0, len(new), LOOK_UP):
                self._look_up(new[k : k + LOOK_UP])
        return [known[w] for w in stems]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row as bytes, and where each text's begin (one end more).

        Arrow splits words, makes them and then their stems unique, and puts
        all back in order; only different stems are looked at one by one.
        """
        compute = pa.compute
        plain = compute.fill_null(texts, "")
        for space in "\n\t\r":
            plain = compute.replace_substring(plain, space, " ")
        lists = compute.split_pattern(plain, " ")
        words = lists.flatten().dictionary_encode()
        lower = compute.ascii_lower(words.dictionary)
        # the one letter that lower-cases to a letter and a mark keeps its stop
        stops = [compute.match_substring_regex(lower, rf"[^\P{{L}}\x{{130}}]{stop}$") for stop in ("\\.", ",")]
        ends = compute.or_(*stops)
        stems = compute.if_else(ends, compute.utf8_slice_codeunits(lower, 0, -1), lower).dictionary_encode()
        stem_ids = pa.array(self._ids(stems.dictionary.to_pylist()), pa.large_binary())
        stop_ids = pa.array(self._ids(["", ".", ","]), pa.large_binary())
        which = compute.add(*[compute.multiply(stop.cast(pa.int8()), n) for n, stop in enumerate(stops, 1)])
        ids = compute.binary_join_element_wise(stem_ids.take(stems.indices), stop_ids.take(which), pa.scalar(b"", pa.large_binary()))
        whole = ids.take(words.indices)
        begins = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = whole.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = lists.offsets.to_numpy().astype(np.int64)
        return data, begins[at - at[0]]


def _slices(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes, or of one text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy()
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, at
            start, held = at, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Cut each document's ids (and ``end_id`` after them) into pieces of at most ``window``.

    A piece: the document, ``start``, ``length``, CRC-32 of its ids as
    little-endian unsigned 32-bit numbers, the document's ids in all, and with
    ``with_ids`` the ``ids`` themselves.  A null or empty text is ``end_id``
    alone; rows that repeat are documents of their own.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordIds(tokenizer), np.array([end_id], "<u4").tobytes()
        for part in (b.slice(i, k - i) for b in batches for i, k in _slices(b.column(1))):
            rows = []
            data, begins = encode(part.column(1))
            view = memoryview(data)
            for doc, begin, stop in zip(part.column(0).to_pylist(), begins.tolist(), begins[1:].tolist()):
                ids = bytes(view[begin:stop]) + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    row = [doc, at, len(piece) // 4, zlib.crc32(piece), n]
                    rows.append(row + [np.frombuffer(piece, "<i4")] if with_ids else row)
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names
            )
        # the worker lives on, for tasks of other kinds
        encode.known.clear()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, schema)


# --- plan over the histogram ---------------------------------------------------


def shallow_fills(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to fill a window of ``units`` exactly by at most ``depth`` lengths, largest first."""
    fills, open_ = [], [((), units, units)]
    while open_:
        parts, left, most = open_.pop()
        if left <= most:
            fills.append((*parts, left))
        if len(parts) + 1 < depth:
            open_ += [((*parts, k), left - k, k) for k in range(1, min(most, left - 1) + 1)]
    return [f for f in fills if f[0]]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: free the column with the steepest
    gain, solve over the free ones, step back to the boundary where one turns negative."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if gain.max(initial=-np.inf) <= slack:
            break
        free[gain.argmax()] = True
        while True:
            at = np.flatnonzero(free)
            best = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (best > slack).all():
                break
            bad = best <= slack
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - best[bad], 1e-300))
            x[at] += min(step, 1.0) * (best - x[at])
            stuck = at[bad & (x[at] <= slack)]
            free[stuck if len(stuck) else at[bad][:1]] = False
            x[~free] = 0
            if not free.any():
                break
        x[:] = 0
        if free.any():
            x[at] = best
    return x


def plan_windows(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a window, repeats) that use up the histogram of lengths 1 to ``units``.

    Repeats of the shallow fills come from least squares, rounded and held to
    what is there; what remains is packed greedily: the longest first, then
    again and again the longest that still fits.  All work is on counts, so it
    is as much for a thousand pieces as for a trillion.
    """
    left = np.zeros(units + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(fill: tuple[int, ...], repeats: int) -> None:
        if repeats > 0:
            plan.append((fill, repeats))
            np.subtract.at(left, list(fill), repeats)

    use((units,), int(left[units]))
    there = np.flatnonzero(left)
    fills = [f for f in shallow_fills(units) if all(left[k] for k in f)]
    if fills:
        row = {int(k): i for i, k in enumerate(there)}
        a = np.zeros((len(there), len(fills)))
        for j, fill in enumerate(fills):
            for k in fill:
                a[row[k], j] += 1
        x = nnls(a, left[there].astype(float))
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            need = np.bincount(fills[j], minlength=units + 1)
            most = min(int(left[k] // need[k]) for k in set(fills[j]))
            use(fills[j], min(int(np.rint(x[j])), most))
    while left.any():
        fill, gap, taken = [], units, np.zeros_like(left)
        while gap and (fit := np.flatnonzero((left - taken)[: gap + 1])).size:
            fill.append(int(fit[-1]))
            taken[fit[-1]] += 1
            gap -= fill[-1]
        use(tuple(fill), min(int(left[k] // taken[k]) for k in set(fill)))
    return plan


def pack(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``window``.

    Lengths count in whole units (rounded up), so the plan has ``window/unit``
    bins, whatever the corpus.  Pieces are numbered within their bin, part by
    part, and a piece's number finds its window in the plan; offsets are sums
    of true lengths, without gaps.  The plan that is broadcast has at most a
    few thousand rows: it grows with the bins, not with the data.
    """
    units = -(-window // unit)
    table = pieces.withColumn("_bin", F.ceil(F.col("length") / unit).cast("int"))
    table = written(table.withColumn("_row", F.monotonically_increasing_id()))
    counts = {r._bin: r.n for r in table.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, sequence, used = [], 0, dict.fromkeys(range(units + 1), 0)
    for fill, repeats in plan_windows(counts, units):
        for length in sorted(set(fill)):
            each = fill.count(length)
            rows.append((length, used[length], used[length] + each * repeats, each, sequence))
            used[length] += each * repeats
        sequence += repeats
    plan = pieces.sparkSession.createDataFrame(
        rows, "_bin int, _from long, _to long, _each long, _first long"
    )
    salts = max(16, sum(counts.values()) // PART_ROWS)
    numbered = ranked(table, ["_bin"], F.pmod(F.xxhash64("_row"), F.lit(salts)), "_rank")
    placed = numbered.join(F.broadcast(plan), "_bin").where("_rank >= _from and _rank < _to")
    placed = placed.withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each"))
    inside = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("_bin"), "_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.select(
        *pieces.columns,
        "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False, **names: str) -> DataFrame:
    """All pieces of ``docs`` with their sequence and offset; no documents, no rows."""
    return pack(token_pieces(docs, tokenizer, with_ids=with_ids, **names))
