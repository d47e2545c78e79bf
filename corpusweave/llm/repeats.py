"""Exact removal of long repeated passages by prefix-free parsing.

A rolling hash of 16 bytes picks triggers: places whose hash is the smallest
within 40 bytes on either side.  Triggers depend on the bytes around them
alone, so equal passages are parsed alike, and phrases from trigger to trigger
take the place of single bytes.  The 400-byte strings (the default;
for other lengths all of this is in proportion) that start in one phrase form a
run.  Its dictionary entry is the whole stretch that they cover, its name in
the parse the bytes after the next trigger that each of the strings contains (305, less for strings that start far before it).  Corpus order is only needed as far as strings agree in 400
bytes, so ranks are fingerprints (64 bits) and not places in a sorted array:

* strings can be equal only under one name; a name that occurs once has none,
* runs of one entry that occurs twice repeat as wholes,
* where a name has several entries, the suffixes of each different entry are
  grouped by the fingerprint of their first 400 bytes, one entry standing for
  all its copies.  This takes the place of suffix arrays of the dictionary and
  of the parse: neither is built, as only equality in 400 bytes is asked.

Strings without a trigger inside (monotonous text) are entries of their own;
those that occur again in their own text are known to repeat at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusweave.llm import hashing
from corpusweave.llm.common import written

LENGTH = 400
GRAM = 16
RADIUS = 40
ZONE = 96


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _scales(length: int) -> tuple[int, int]:
    """Radius and zone for strings of ``length`` bytes: those of 400 in proportion.  A zone is
    at most what decides on a trigger, so that every name has a byte."""
    radius = max(1, RADIUS * length // LENGTH)
    return radius, max(1, min(ZONE * length // LENGTH, 2 * radius + GRAM))


def triggers(sums: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places whose 16-byte hash is below the ``radius`` before and not above those after."""
    n = len(sums) - GRAM
    if n < 2 * radius + 1:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    h = hashing.spans(sums, at, at + GRAM) >> np.uint64(32)
    h = h.astype(np.uint32)
    least = _least(h, radius)
    here = h[radius : n - radius]
    before = least[: len(here)]
    after = least[radius + 1 : radius + 1 + len(here)]
    return np.flatnonzero((here < before) & (here <= after)) + radius


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``name, entry, first, last`` of the runs that all strings of a text fall into."""
    last_start = len(data) - length
    if last_start < 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    sums = hashing.prefixes(data)
    radius, zone_width = _scales(length)
    at = triggers(sums, radius)
    reach = length - radius - GRAM  # a trigger counts with all bytes that decide on it
    before = np.concatenate(([-(1 << 62)], at[:-1]))
    first = np.maximum(np.maximum(before - radius + 1, at - reach), 0)
    last = np.minimum(at - radius, last_start)
    some = first <= last
    at, first, last = at[some], first[some], last[some]
    covered = np.zeros(last_start + 2, np.int8)
    np.add.at(covered, first, 1)
    np.add.at(covered, last + 1, -1)
    bare = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)

    # by how far a string starts before the trigger: the nearer, the longer what all share
    low, high = (at - radius - last) // zone_width, (at - radius - first) // zone_width
    each = np.repeat(np.arange(len(at)), high - low + 1)
    zone = np.arange(len(each)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    zone += low[each]
    start = at[each] - radius
    first = np.maximum(first[each], start - zone_width * (zone + 1) + 1)
    last = np.minimum(last[each], start - zone_width * zone)
    name = hashing.spans(sums, start, start + length - zone_width * (zone + 1) + 1)
    name = hashing.mix(name + zone.astype(np.uint64))
    entry = hashing.spans(sums, first, last + length)
    entry = hashing.mix(entry + hashing.mix(((start - first) << 32 | (last - first)).astype(np.uint64)))

    whole, alone, twice, twice_last = _bare(sums, bare, length)
    return (
        np.concatenate((name, whole, np.repeat(hashing.mix(~hashing.spans(sums, twice, twice + length)), 2))),
        np.concatenate((entry, whole, np.zeros(2 * len(twice), np.uint64))),
        np.concatenate((first, alone, np.repeat(twice, 2))),
        np.concatenate((last, alone, np.repeat(twice_last, 2))),
    )


def _bare(sums: np.ndarray, bare: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Strings without a trigger: each different one once (hash, place), and the stretches
    (first, last) of those that occur again in the text itself."""
    hashes = hashing.mix(hashing.spans(sums, bare, bare + length) + np.uint64(1))
    whole, place, which, n = np.unique(
        hashes, return_index=True, return_inverse=True, return_counts=True
    )
    again = bare[n[which] > 1]
    breaks = np.flatnonzero(np.diff(again) > 1)
    ends = np.append(breaks, len(again) - 1) if len(again) else breaks
    starts = np.concatenate(([0], breaks + 1)) if len(again) else breaks
    return whole, bare[place], again[starts], again[ends]


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _signed(values: list[np.ndarray]) -> pa.Array:
    whole = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.array(whole.view(np.int64), pa.int64())


def _parse(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "name", "entry", "first", "last"]
    for batch in batches:
        docs = batch.column(0).to_numpy()
        parts = [runs(_bytes(text), length) for text in batch.column(1)]
        columns = list(zip(*parts)) if parts else [()] * 4
        owner = np.repeat(docs, [len(p[0]) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(owner), *[_signed(list(c)) for c in columns]], names)


def _suffixes(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, starts, copies, found = [], [], [], []
        for doc, text, entries in zip(*(batch.column(i) for i in range(3))):
            sums = hashing.prefixes(_bytes(text))
            for e in entries.as_py():
                at = np.arange(e["first"], e["last"] + 1)
                owner.append(np.full(len(at), doc.as_py()))
                starts.append(at)
                copies.append(np.full(len(at), e["copies"]))
                found.append(hashing.spans(sums, at, at + length))
        yield pa.RecordBatch.from_arrays(
            [_signed(c) for c in (owner, starts, copies, found)], ["doc", "start", "copies", "rank"]
        )


def _union(spans: list[dict]) -> list[list[int]]:
    """Sorted, disjoint and not adjoining stretches."""
    merged: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _cut(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            gone, at, kept = _union(spans.as_py() or []), 0, []
            gone = [(s, e) for s, e in gone if len(data[s:e].split()) >= min_words]
            for s, e in gone:
                kept.append(data[at:s])
                at = e
            rest = b"".join([*kept, data[at:]])
            removed = len(data) - len(rest)
            rows.append((len(data), removed, len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
            ["record", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, spans`` (array of ``s, e``) of the bytes of ``texts(doc, text)`` that lie in a
    string of ``length`` bytes that also starts anywhere else; spans may overlap."""
    # parsed twice, which is cheaper than keeping the parse of everything
    parsed = texts.mapInArrow(
        partial(_parse, length), "doc long, name long, entry long, first long, last long"
    )
    names = parsed.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("entry").alias("lo"), F.max("entry").alias("hi")
    )
    narrow = [F.col(c).cast("int") for c in ("first", "last")]
    parsed = parsed.select("doc", "name", "entry", *narrow)
    shared = parsed.join(names.where("n > 1").drop("n"), "name")
    shared = written(shared.select("doc", "entry", "first", "last", F.expr("lo < hi").alias("mixed")))
    whole = shared.where("not mixed")
    mixed = shared.where("mixed")
    entries = mixed.groupBy("entry").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by(F.struct("doc", "first", "last"), F.struct("doc", "first")).alias("at"),
    )
    entries = written(entries)
    copied = mixed.join(entries.where("copies > 1").select("entry"), "entry")
    single = entries.select("at.*", "copies").groupBy("doc")
    asked = single.agg(F.collect_list(F.struct("first", "last", "copies")).alias("entries"))
    suffixes = written(
        texts.join(asked, "doc").select("doc", "text", "entries").mapInArrow(
            partial(_suffixes, length), "doc long, start long, copies long, rank long"
        )
    )
    ranks = suffixes.groupBy("rank").agg(F.sum("copies").alias("n"))
    again = suffixes.where("copies = 1").join(ranks.where("n > 1").select("rank"), "rank")
    span = F.struct(F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    found = whole.select("doc", span.alias("span")).union(copied.select("doc", span.alias("span")))
    found = found.union(again.select("doc", F.expr(f"struct(start as s, start + {length} as e)")))
    return found.groupBy("doc").agg(F.collect_list("span").alias("spans"))


def without_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, min_words: int = 0
) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    With ``min_words`` only stretches (maximal runs of such bytes) of as many words, split
    ones at their ends included, go.

    Texts are their UTF-8 bytes (a null text is empty); strings lie within one
    document, may overlap, and are judged on the input.  Returns a row for
    each row of ``docs``: ``record`` (a struct of all its columns), ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` of the
    remaining bytes and ``kept``, their text less characters that a cut splits.  Documents under ``length`` bytes stay whole, a
    document of which there is a copy (a repeated row included) loses all.
    """
    columns = [(F.col(f"`{c.replace('`', '``')}`"), kind) for c, kind in docs.dtypes]
    plain = [F.to_json(F.struct(c)) if "map<" in kind else c for c, kind in columns]
    keyed = docs.select(
        F.struct("*").alias("record"), F.xxhash64(*plain).alias("doc"), F.col(text).alias("text")
    )
    spans = repeated_spans(keyed.select("doc", "text"), length)
    joined = keyed.join(spans, "doc", "left").select("record", "text", "spans")
    schema = StructType([joined.schema["record"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept_sha256", "string").add("kept", "string")
    return joined.mapInArrow(partial(_cut, min_words), schema)
